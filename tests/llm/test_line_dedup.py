import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from proofgrid.llm.line_dedup import dedup_lines

BIG = (1 << 63) - 1


def brute(rows, depth=3, alike=0.8, least=3):
    """The same rules over Python lists: {(id, text): indexes dropped}."""
    docs = sorted({(BIG if i is None else i, t) for i, t in rows if t is not None})
    lines = []
    for key in docs:
        for idx, line in enumerate(key[1].split("\n")):
            words = tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(words) >= least:
                lines.append((key, idx, words))
    leaves = defaultdict(list)
    for key, idx, words in lines:
        leaves[len(words), words[:depth]].append((key, idx, words))
    drop, again = defaultdict(set), []
    for own in leaves.values():
        templates = defaultdict(list)
        joined = joins(own, depth, alike) if len({x[0] for x in own}) > 1 else {}
        for key, idx, words in own:
            while words in joined:
                words = joined[words]
            templates[words].append((key, idx, len(words)))
        for found in templates.values():
            first = min(found)[0]
            again += [(key, idx, n, first) for key, idx, n in found if key != first]
    size, taken = Counter(), Counter()
    for key, _, words in lines:
        size[key] += len(words)
    for key, _, n, first in again:
        taken[key, first] += n
    lead = {}
    for (key, first), n in sorted(taken.items(), key=lambda x: (x[1], -x[0][1][0])):
        if 2 * n >= size[key] and 2 * n >= size[first]:
            lead[key] = first
    for key, idx, _, first in again:
        if lead.get(key, key) != lead.get(first, first):
            drop[key].add(idx)
    return drop


def joins(own, depth, alike):
    """{words: lead's words} of one leaf, every line of a band against every lead, until no band has two lines."""
    times = Counter(x[2] for x in own)
    body = {w: hashlib.md5(" ".join(w).encode()).digest() for w in times}
    rank = lambda w: (times[w], body[w])
    n = len(own[0][2])
    apart = n - math.ceil(alike * n)
    if not apart:
        return {}
    edge = [depth + (n - depth) * j // (apart + 1) for j in range(apart + 2)]
    lists = defaultdict(set)
    for w in times:
        for j in range(apart + 1):
            lists[j, w[edge[j] : edge[j + 1]]].add(w)
    out, groups = {}, 1
    while any(len(band) > 1 for band in lists.values()):
        near = {}
        for band in lists.values():
            tops = {}
            for w in band:
                part = zlib.crc32(body[w]) % groups
                tops[part] = max(tops.get(part, w), w, key=rank)
            for lead in tops.values():
                for w in band - {lead}:
                    if sum(a == b for a, b in zip(w, lead, strict=True)) >= alike * n:
                        low, high = sorted((w, lead), key=rank)
                        near[low] = max(near.get(low, high), high, key=rank)
            band -= set(tops.values())
        out |= near
        for band in lists.values():
            band.difference_update(near)
        groups = min(2 * groups, 64)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(dedup_lines(df).collect(), key=repr)
    drop = brute(rows)
    want = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        out = drop[BIG if i is None else i, t]
        want.append((i, t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in out), len(lines), len(out)))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: repr(spark_row(r)))
    return got


def spark_row(r):
    from pyspark.sql import Row

    return Row(doc_id=r[0], text=r[1], n_lines=r[2], n_dropped=r[3])


def test_documents_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert sum(r.n_dropped for r in got) > 0


def test_templates_copies_and_odd_rows(spark):
    prose = "\n".join(f"one line of plain words about {a} and {b}" for a, b in (("sun", "moon"), ("sea", "sand"), ("oak", "ash"), ("red", "blue")))
    rows = [
        (1, "shared footer line here\nalpha beta gamma delta epsilon zeta eta theta"),
        (2, "other first words stand in this line\nshared footer line here\nno end to words that this text alone has"),
        (3, "page 3 of 9 was printed\nwords that only the third text has of its own kind"),
        (4, "page 12 of 77 was printed\nand the fourth has quite another line than these"),
        (5, prose), (6, prose), (7, prose + "\nshared footer line here"),
        (8, None), (9, ""), (10, "\n\n"), (11, "two words\ntwo words"), (12, "two words"), (None, "shared footer line here"),
        (13, "x " * 5000 + "9"), (13, "x " * 5000 + "9"),
    ]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[2].n_dropped == 1 and "footer" not in got[2].text
    assert got[4].n_dropped == 1 and got[3].n_dropped == 0
    assert got[6].n_dropped == 0 and got[7].text == prose
    assert got[12].n_dropped == 0 and got[8].text is None and got[None].n_dropped == 1


def test_empty_table_and_clashing_columns(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(i, f"shared footer line here\nown {'abc'[i]} x y and more words than the line that all share", 7 + i, 8, "o", "k", "d", "r") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, N_DROPPED int, o string, K string, drop string, row string")
    got = sorted(tuple(r) for r in dedup_lines(df).collect())
    assert got == [(*rows[0], 2, 0), *((i, rows[i][1].split("\n")[1], *rows[i][2:], 2, 1) for i in (1, 2))]
    assert dedup_lines(df).columns[-2:] == ["n_lines_", "n_dropped_"]


def test_a_leaf_holds_several_templates(spark):
    one = lambda w: f"sent from my phone by {w} on the way to work today"
    two = lambda w: f"sent from my desk while {w} was reading all of those letters"
    three = lambda w: f"sent from my garden where {w} grows tall beside seven old walls"
    names = ["Ann", "Bob", "Cyd", "Dan", "Eve"]
    assert len({len(f(n).split()) for f in (one, two, three) for n in names}) == 1
    lines = [f(n) for f, m in ((one, 5), (two, 4), (three, 3)) for n in names[:m]] + ["sent from my own house no line is like this one here"]
    got = check(spark, [(i, f"{x}\ntext that {'abcdefghijklmnop'[i] * 9} alone has of its own, and it goes on for more than twenty words so that no other line makes half of it") for i, x in enumerate(lines)])
    assert sorted(r.doc_id for r in got if not r.n_dropped) == [0, 5, 9, 12]


def own_text(i):
    return " ".join(f"own{'abcdefghijklmnopqrstuvwxyz'[i // 26]}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{c}{d}" for d in "abcdefgh" for c in "jklmn")


def test_templates_that_share_one_band_are_all_found(spark):
    for n_templates, n_lines in ((4, 5), (40, 3)):
        name = lambda i: "abcdefghijklmnopqrstuvwxyz"[i // 26] + "abcdefghijklmnopqrstuvwxyz"[i % 26]
        line = lambda t, v: f"one two three same band words t{name(t)} u{name(t)} v{name(t)} w{name(t)} x{name(t)} y{name(t)} name{name(v)}"
        rows = [(t * n_lines + v, f"{line(t, v)}\n{own_text(t * n_lines + v)}") for t in range(n_templates) for v in range(n_lines)]
        got = check(spark, rows)
        assert Counter(r.doc_id // n_lines for r in got if r.n_dropped) == {t: n_lines - 1 for t in range(n_templates)}


def test_random_lines_of_few_words_match_brute_force(spark):
    dice = random.Random(5)
    line = lambda: "all lines begin " + " ".join(dice.choice("abc") for _ in range(dice.choice((5, 8, 10))))
    got = check(spark, [(i, f"{line()}\n{own_text(i)}") for i in range(400)])
    assert sum(r.n_dropped for r in got) > 100


def test_ids_that_are_no_integers(spark):
    rows = [(i, f"shared footer line here\n{own_text(k)}") for k, i in enumerate(["a", "b", None, "7"])]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(r.n_dropped for r in got) == [0, 1, 1, 1] and {r.doc_id for r in got} == {"a", "b", None, "7"}
    assert next(r for r in got if r.doc_id is None).n_dropped == 1


def test_a_long_line_of_short_documents_is_no_copy(spark):
    line = " ".join(f"shared{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    own = lambda i: " ".join(f"own{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    rows = [(i, f"{line}\n{own(i)}") for i in range(100)] + [(100, f"{line}\n{own(7)}")]
    near = own(7).split(" ")
    near[20] = "changed"
    rows.append((101, f"{line}\n{' '.join(near)}"))
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), link=75).collect()}
    assert [i for i, r in got.items() if line in r.text] == [0]
    assert all(got[i].text == own(i) for i in range(1, 100))


def test_the_query_and_the_pipeline_ask_for_the_join_s_link(spark, tmp_path):
    import corpus_pipeline
    from proofgrid.llm.queries import op5_line_dedup

    line = " ".join(f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    rows = [(i, line + "\n" + " ".join(f"{'wxyz'[i]}{c}{d}" for d in "abcdefgh" for c in "jklmn")) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.n_dropped for r in op5_line_dedup(spark, str(tmp_path)).collect()) == [0, 1, 1, 1]
    assert sum(line in r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()) == 1


def test_copies_that_the_join_links_stay_whole(spark):
    body = "\n".join(" ".join(f"{a}{b}{c}" for c in "mnopqrstuv") for a in "abcde" for b in "fgh")
    words = body.split(" ")
    words[70] = "changed"
    rows = [(1, body), (2, body), (3, " ".join(words)), (4, None), (5, "\n".join(body.split("\n")[:9] + ["words that no other text has " + a * 9 for a in "abcdefgh"]))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), link=75).collect()}
    assert [got[i].n_dropped for i in (1, 2, 3, 4)] == [0, 0, 0, 0] and got[5].n_dropped == 9


def test_the_query_and_the_pipeline_judge_short_lines(spark, tmp_path):
    import corpus_pipeline
    from proofgrid.llm.queries import op5_line_dedup

    own = lambda i: " ".join(f"{'wxyz'[i]}{c}{d}" for d in "abcdefgh" for c in "jklmn")
    rows = [(i, f"Read more\n{own(i)}\nPage {i + 7}\n\nShare") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.n_dropped for r in op5_line_dedup(spark, str(tmp_path)).collect()) == [0, 3, 3, 3]
    less = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert less == {0: rows[0][1]} | {i: f"{own(i)}\n" for i in range(1, 4)}
    assert sorted(lines_dropped(dedup_lines(docs, least_words=1))) == sorted((i, len(x)) for (i, _), x in brute(rows, least=1).items())


def lines_dropped(df):
    return [(r.doc_id, r.n_dropped) for r in df.collect() if r.n_dropped]
