"""What a shift means: evidence for each source of incoming data, and one of five verdicts over all of it.

``spikes`` and ``artifacts`` gather a source's evidence against the reference; ``interpret`` weighs it: a source with an artifact
that keeps its place, or with two signals that no other source shows, makes the shift suspicious; otherwise a shift is one of
content, operational or undetermined, or there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import special
from proofgrid.operators import statistics as st

# The thresholds of the rules.
LEAST, HOT, RATIO, RATE, ALPHA, AUC, SPIKE, LOW = 15, 6.0, 3.0, 0.1, 1e-3, 0.7, 0.15, 0.33
#: Turns a median absolute deviation into a standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def spikes(rows: DataFrame) -> DataFrame:
    """(grp, n, spike_class, spike): the class whose share rose most against the reference, from (is_ref, grp, cls); the first
    by name of equals. Sources of fewer than LEAST rows have no row."""
    known = rows.filter("cls IS NOT NULL")
    ref = known.filter("is_ref").groupBy("cls").agg(F.count("*").alias("r"))
    total = ref.agg(F.sum("r").alias("all_r"))
    cur = known.filter("NOT is_ref AND grp IS NOT NULL")
    size = cur.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    own = cur.groupBy("grp", "cls").agg(F.count("*").alias("c"))
    classes = own.select("cls").union(ref.select("cls")).distinct()
    every = size.join(classes).join(own, ["grp", "cls"], "left").join(ref, "cls", "left").join(F.broadcast(total))  # a row for each source and class
    rise = F.coalesce("c", F.lit(0)) / F.col("n") - F.coalesce("r", F.lit(0)) / F.col("all_r")
    best = every.withColumn("rise", rise).groupBy("grp", "n").agg(F.min(F.struct((-F.col("rise")).alias("m"), "cls")).alias("x"))
    return best.select("grp", "n", F.col("x.cls").alias("spike_class"), (-F.col("x.m")).alias("spike"))


def artifacts(energies: DataFrame) -> DataFrame:
    """(grp, n, pos, rate, reference_rate, ratio, q, present): where a source's images are hot most beyond the reference's,
    from (id, is_ref, grp, pos, energy): one row for each image and window.

    A window is hot if its log energy is HOT robust deviations above the reference's median there; sources are tested at
    each place by a binomial tail, adjusted over places.
    """
    logs = energies.withColumn("e", F.log(F.col("energy") + 1e-6))
    ref = logs.filter("is_ref")
    middle = ref.groupBy("pos").agg(F.median("e").alias("med"), F.count("*").alias("n_ref"))
    spread = ref.join(middle, "pos").groupBy("pos", "med", "n_ref").agg(F.greatest(F.median(F.abs(F.col("e") - F.col("med"))) * MAD_SCALE, F.lit(1e-6)).alias("mad"))
    marked = logs.join(F.broadcast(spread), "pos").withColumn("hot", ((F.col("e") - F.col("med")) / F.col("mad") > HOT).cast("long"))  # a row for each place
    base = marked.filter("is_ref").groupBy("pos", "n_ref").agg(F.avg("hot").alias("reference_rate"))
    own = marked.filter("NOT is_ref AND grp IS NOT NULL").groupBy("grp", "pos").agg(F.sum("hot").alias("k"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    both = own.join(F.broadcast(base), "pos").withColumn("floor", F.greatest("reference_rate", 0.5 / F.col("n_ref")))
    both = both.withColumn("p", special.binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), "floor"))
    tested = st.bh_qvalues(both, "p", ["grp"]).withColumn("rate", F.col("k") / F.col("n")).withColumn("ratio", F.col("rate") / F.col("floor"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy("q", "pos"))
    best = tested.withColumn("_i", first).filter("_i = 1")
    present = (F.col("q") < ALPHA) & (F.col("rate") >= RATE) & (F.col("ratio") >= RATIO)
    return best.select("grp", "n", "pos", "rate", "reference_rate", "ratio", "q", present.alias("present"))


def interpret(sources: DataFrame, overall: DataFrame) -> DataFrame:
    """One row (verdict, grp, signals, score, severity, confidence).

    ``sources``: (grp, low_level, auc, artifact, artifact_q, spike); auc and spike may be null. ``overall``: one row (material,
    low_level, auc, semantic).
    """
    auc, spike = F.coalesce("auc", F.lit(0.5)), F.coalesce("spike", F.lit(0.0))
    say = lambda when, name: F.when(when, F.lit(name))
    rows = sources.withColumn("signals", F.array_compact(F.array(say(F.col("artifact"), "artifact"), say(auc >= AUC, "semantic shift"), say(spike >= SPIKE, "class spike"))))
    rows = rows.withColumn("loud", (F.col("artifact") | (auc >= AUC)).cast("int"))
    about = rows.agg(F.count("*").alias("groups"), F.coalesce(F.sum("loud"), F.lit(0)).alias("all_loud"), F.min("low_level").alias("least"))
    rows = rows.crossJoin(F.broadcast(about))  # one row
    confined = (F.size("signals") >= 2) & (F.col("all_loud") == F.col("loud")) & (F.col("groups") >= 2)
    first = F.struct((-F.size("signals")).alias("s"), F.col("artifact_q").alias("q"), "grp", "signals")
    worst = rows.filter(F.col("artifact") | confined).agg(F.min(first).alias("w"))
    one = overall.select("material", F.col("low_level").alias("low"), F.col("auc").alias("all_auc"), "semantic").crossJoin(F.broadcast(about)).crossJoin(F.broadcast(worst))  # one row each
    shifted = F.col("low") >= LOW
    met = [shifted, F.col("all_auc").isNotNull() & ~F.col("semantic"), (F.col("groups") >= 2) & (F.col("least") >= LOW)]
    score = (sum((F.coalesce(m, F.lit(False)).cast("int") for m in met), F.lit(2))) / 5
    suspicious, moved = F.col("w").isNotNull(), F.col("material") | F.col("semantic")
    verdict = F.when(suspicious, "suspicious").when(moved & F.col("semantic") & ~shifted, "content").when(moved & (score >= 0.6), "operational").when(moved, "undetermined").otherwise("none")
    size = F.size("w.signals")
    return one.select(
        verdict.alias("verdict"), F.col("w.grp").alias("grp"), F.col("w.signals").alias("signals"), F.when(~suspicious & moved, score).alias("score"),
        F.when(suspicious, "HIGH").when(moved, "MEDIUM").otherwise("INFO").alias("severity"), F.when(suspicious, F.least(F.lit(0.9), 0.45 + 0.15 * size)).when(moved, score).otherwise(F.lit(0.8)).alias("confidence"),
    )
