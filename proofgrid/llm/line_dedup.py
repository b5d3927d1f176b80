"""Line dedup with a tree of line templates, with DataFrame functions only.

A line's words are parsed to a fixed depth: words with a digit become a variable field, then the number of
words and the first ``depth`` words lead to a leaf. A leaf may hold any number of templates. Two lines can share
one if at least ``alike`` of their places hold the same word; as at most d places then differ, the places behind
the first ``depth`` are cut into d + 1 bands, of which one at least is equal. In each band of equal words the line
that occurs most often leads; a line joins the most frequent lead that it is alike to, and where they differ is
another variable field. Lines that joined none meet new leads among themselves in further rounds, until no band has
two lines left: two lines that share a band and are alike are compared unless one has joined a template before. Each
round has twice the leads of the last (the most frequent line of each of so many parts of a band by hash, ``MOST_LEADS``
at most), so that a band of many templates needs few rounds. What leads a line may itself have joined another: the
template is that of the last.

A template that occurs in two documents or more is recurring: its lines are dropped, except the first, in the
document with the least id. Copies of whole documents are not a matter of lines: a document follows an earlier
one if lines first seen there make at least half of the words of both, and the Jaccard index of their sets of word
``GRAM``-grams is at least ``link`` percent; lines first seen in the document that it follows, or in another that
follows the same, stay. They are left whole for deduplication of documents. The queries ask for the ``LINK`` of the
n-gram join, so that only documents that it merges are left; with ``link`` 0 the shared lines alone decide.

Lines that make a thousandth of all lines or more are few and go by broadcast, so no task holds one of them.

Lines are parts between line feeds; lines of fewer than ``least_words`` words stay (the queries judge every line
with a word). A null text has no lines
and stays null. Rows that share id and text count as one document. Ids that aren't integers are ordered by their hash.
Rows without an id come last in the order.
All columns go along whatever their names; a count whose name is taken gets an underscore (``n_lines_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import SPACE, cut, free_name, row_of, shared_join

FIELD = "<*>"
#: What links two documents in the n-gram join: words of a gram, and the least percent of their Jaccard index.
GRAM = 5
LINK = 75
#: Leads of a band in one round, at most (a band of more templates takes more rounds).
MOST_LEADS = 64


BLANK = r"\x20\x09\x0B-\x0D"


def prepared(line: Column) -> Column:
    """The words of a line, one space apart, with a variable field for each word that has a digit. Patterns run only over
    lines where a plain search finds something to do."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in ("  ", "\t", "\v", "\f", "\r"):
        odd |= F.contains(line, F.lit(c))
    plain = F.when(odd, F.trim(F.regexp_replace(line, f"[{BLANK}]+", " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*[0-9][^ ]*", FIELD)).otherwise(plain)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(o, k, idx, n, leaf, body): one row for each line with a word."""
    out = docs.select("o", "k", F.posexplode(F.split("text", "\n")).alias("idx", "line")).filter(F.col("line").rlike(f"[^{SPACE}]"))
    out = out.select("o", "k", "idx", prepared(F.col("line")).alias("words"))
    n = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(n, F.substring_index("words", " ", depth))
    return out.select("o", "k", "idx", n.alias("n"), leaf.alias("leaf"), F.unhex(F.md5(F.col("words").cast("binary"))).alias("body"))


def _grams(text: Column) -> Column:
    """The n-gram join's set of a text with a word, as an array of hashes."""
    words = F.split(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+")
    # the array of one holds the words, so that they are made once for all grams
    of = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - GRAM + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, GRAM))))
    return F.transform(F.array(words), of)[0]


def _linked(pairs: DataFrame, docs: DataFrame, link: int) -> DataFrame:
    """Those of ``pairs`` (o, k, fo, fk, same) whose Jaccard index is at least ``link`` percent. Equal texts need no look."""
    unlike = pairs.filter("k <> fk")
    text = docs.dropDuplicates(["o", "k"])
    both = unlike.join(text.select(F.col("o").alias("fo"), F.col("k").alias("fk"), F.col("text").alias("theirs")), ["fo", "fk"]).join(text, ["o", "k"])
    # arrays of one hold the sets and then their sizes, so that each is made once for all its uses
    sets = F.array(F.struct(_grams(F.col("text")).alias("a"), _grams(F.col("theirs")).alias("b")))
    sizes = F.transform(sets, lambda s: F.struct((F.size(s["a"]) + F.size(s["b"])).alias("sum"), F.size(F.array_intersect(s["a"], s["b"])).alias("common")))
    linked = F.transform(sizes, lambda z: 100 * z["common"] >= link * (z["sum"] - z["common"]))[0]
    return pairs.filter("k = fk").unionByName(both.filter(linked).select("o", "k", "fo", "fk", "same"))


def _words_of(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """``kinds`` (leaf, body, at, times) with their words, read again from the text of one line of each."""
    places = kinds.groupBy("at.o", "at.k").agg(F.collect_list(F.struct("at.idx", "leaf", "body", "times")).alias("want"))
    found = docs.join(places, ["o", "k"]).select("text", "want")
    # the array of one holds the lines of a text, so that they are made once for all lines wanted of it
    pick = lambda all_: F.transform("want", lambda w: F.struct(w["leaf"].alias("leaf"), w["body"].alias("body"), w["times"].alias("times"), F.element_at(all_, w["idx"] + 1).alias("line")))
    found = found.select(F.explode(F.transform(F.array(F.split("text", "\n")), pick)[0]).alias("w")).select("w.*")
    found = found.select("leaf", "body", "times", F.split(prepared(F.col("line")), " ").alias("words"))
    return found.distinct()  # rows that repeat name their lines again


def _templates(kinds: DataFrame, depth: int, alike: float) -> DataFrame:
    """(body, template) of the lines that joined another: ``kinds`` has (leaf, body, times, words)."""
    n = F.size("words")
    apart = (n - F.ceil(F.lit(alike) * n)).cast("int")
    start = lambda j: (F.lit(depth) + F.floor((n - depth) * j / (apart + 1))).cast("int")
    band = F.transform(F.sequence(F.lit(0), apart), lambda j: F.xxhash64("leaf", j, F.slice("words", start(j) + 1, start(j + 1) - start(j))))
    bands = cut(kinds.filter(apart > 0).select("body", "times", F.explode(band).alias("band")), "bands")
    mine = kinds.select("body", "words")
    theirs = kinds.select(F.col("body").alias("lead"), F.col("words").alias("others"))
    joined, groups = None, 1
    while True:
        tops = bands.groupBy("band", (F.crc32("body") % groups).alias("group")).agg(F.max(F.struct("times", "body")).alias("top"), F.count("*").alias("n"))
        tops = cut(tops.groupBy("band").agg(F.collect_list("top").alias("tops"), F.sum("n").alias("n")).filter("n > 1"), "leads")
        total = tops.agg(F.sum("n")).first()[0]
        if not total:
            break
        met = cut(shared_join(bands, tops, ["band"], "n", total).drop("n"), "bands")
        pairs = met.select(F.struct("times", "body").alias("own"), F.explode("tops").alias("top")).filter("own.body <> top.body")
        pairs = pairs.select(F.least("own", "top").alias("low"), F.greatest("own", "top").alias("high")).select("low.body", F.col("high.body").alias("lead"), F.col("high.times").alias("often")).distinct()
        same = F.aggregate(F.zip_with("words", "others", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        near = pairs.join(mine, "body").join(theirs, "lead").filter((F.size("words") == F.size("others")) & (same >= F.lit(alike) * n))
        near = cut(near.groupBy("body").agg(F.max(F.struct("often", "lead")).alias("x")).select("body", F.col("x.lead").alias("template")), "joined")
        joined = near if joined is None else joined.unionByName(near)
        bands = met.filter(~F.array_contains("tops.body", F.col("body"))).select("band", "body", "times").join(near, "body", "left_anti")
        groups = min(2 * groups, MOST_LEADS)
    if joined is None:
        return kinds.select("body", F.col("body").alias("template")).limit(0)
    while True:  # to the last lead: steps double, and every step leads to a more frequent line
        up = joined.select(F.col("body").alias("template"), F.col("template").alias("next"))
        step = cut(joined.join(up, "template", "left").select("body", F.coalesce("next", "template").alias("template"), F.col("next").isNotNull().alias("moved")), "joined")
        joined = step.select("body", "template")
        if not step.filter("moved").limit(1).count():
            return joined


def dropped_lines(docs: DataFrame, depth: int = 3, alike: float = 0.8, least_words: int = 3, link: int = 0) -> DataFrame:
    """(o, k, drop): for documents (o, k, text), the indexes of the lines to drop, where there are any."""
    lines = cut(_lines(docs, depth), "lines").filter(F.col("n") >= least_words)
    # over all lines only numbers are aggregated, which needs no sort
    kind = F.xxhash64("body")
    leaves = lines.groupBy("leaf").agg(F.min("o").alias("a"), F.max("o").alias("b"), F.min("k").alias("c"), F.max("k").alias("d"), (F.min(kind) != F.max(kind)).alias("mixed"), F.count("*").alias("all"))
    leaves = cut(leaves.filter("a <> b OR c <> d").select("leaf", "mixed", "all"), "leaves")
    total = lines.count()
    shared = cut(shared_join(lines, leaves, ["leaf"], "all", total).drop("all"), "shared")
    low = F.struct("at.o", "at.k")
    bodies = cut(shared.groupBy("body").agg(F.min("leaf").alias("leaf"), F.max("mixed").alias("mixed"), F.min(F.struct("o", "k", "idx")).alias("at"), F.max(F.struct("o", "k")).alias("high"), F.count("*").alias("times")), "bodies")
    kinds = cut(_words_of(bodies.filter("mixed").select("leaf", "body", "at", "times"), docs), "kinds")
    own = bodies.join(_templates(kinds, depth, alike), "body", "left").withColumn("template", F.coalesce("template", "body"))
    first = own.groupBy("template").agg(F.min("at").alias("first"), F.min(low).alias("low"), F.max("high").alias("high")).filter("low <> high").select("template", "first")
    again = cut(own.join(first, "template").select("body", "times", F.col("first.o").alias("fo"), F.col("first.k").alias("fk")), "recurring")
    again = shared_join(shared.drop("leaf", "mixed"), again, ["body"], "times", total).drop("times")
    again = cut(again.filter("o <> fo OR k <> fk").select("o", "k", "idx", "n", "fo", "fk"), "again")

    size = lines.groupBy("o", "k").agg(F.sum("n").alias("size"))
    taken = again.groupBy("o", "k", "fo", "fk").agg(F.sum("n").alias("same"))
    taken = taken.join(size, ["o", "k"]).filter("2 * same >= size").drop("size")
    taken = taken.join(size.select(F.col("o").alias("fo"), F.col("k").alias("fk"), "size"), ["fo", "fk"]).filter("2 * same >= size").select("o", "k", "fo", "fk", "same")
    if link:
        taken = _linked(cut(taken, "taken"), docs, link)
    lead = taken.groupBy("o", "k").agg(F.max(F.struct("same", (-F.col("fo")).alias("no"), F.struct(F.col("fo").alias("o"), F.col("fk").alias("k")).alias("lead"))).alias("x")).select("o", "k", F.col("x.lead").alias("lead"))
    lead = cut(lead, "lead")
    out = again.join(lead, ["o", "k"], "left").join(lead.select(F.col("o").alias("fo"), F.col("k").alias("fk"), F.col("lead").alias("theirs")), ["fo", "fk"], "left")
    mine = F.coalesce("lead", F.struct("o", "k"))
    theirs = F.coalesce("theirs", F.struct(F.col("fo").alias("o"), F.col("fk").alias("k")))
    return out.filter((mine["o"] != theirs["o"]) | (mine["k"] != theirs["k"])).groupBy("o", "k").agg(F.collect_list("idx").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text less its dropped lines, and n_lines and n_dropped (long)."""
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))
    o = F.coalesce(number, F.lit((1 << 63) - 1)).alias("o")
    k = F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("k")
    drops = dropped_lines(docs.select(o, k, F.col(text_col).alias("text")), **options)
    out = docs.select(o, k, row_of(docs).alias("row")).join(drops, ["o", "k"], "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    less = F.when(F.col("drop").isNull(), text).otherwise(kept)
    own = [less.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    n_lines, n_dropped = F.coalesce(F.size(lines), F.lit(0)).cast("long"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")
    return out.select(*own, n_lines.alias(free_name(docs, "n_lines")), n_dropped.alias(free_name(docs, "n_dropped")))
