"""Problem 2: rows of several sources mixed so that each source holds its share of the total size.

Method. A mix is a schedule of slots of equal size. Slot i goes to the source whose interval of the cumulative shares
holds the golden-ratio point frac(i * phi), so every prefix of the schedule holds every share up to a few slots. Slots
are ranked per source; the rows of a source, in the order of a hash and repeated as often as needed, form a stream cut into
blocks of equal token counts; block k of a source meets its k-th slot.

The size of a mix is the largest at which no source needs more than its cap: the least, over the sources, of
tokens * max_repeats / share. Sources that do not exist get no slots; the shares of the others are scaled to sum to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.functions import text as T
from corpusops.operators.ranking import running_total
from corpusops.runtime import written

GOLDEN = 0.6180339887498949
#: Slots of a mix: at least LEAST_SLOTS, more where a slot would exceed SLOT_TOKENS.
LEAST_SLOTS = 4096
SLOT_TOKENS = 65_536
ROWS_A_SLICE = 100_000


def label(source: Column) -> Column:
    """Source labels in one spelling: lower case, letters and digits only, no plural s. Null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(T.unicode_form(source, "NFKC")), r"[^\p{L}\p{N}]+", ""), "s$", "")


def mix(rows: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(placements, report) for rows(id, source, source_subtype, tokens) and targets with the columns of mix_targets.

    placements(mix_name, slot, offset_in_slot, source, source_subtype, id, repeat_no, tokens): a mix in order of
    (slot, offset_in_slot, id, repeat_no). report: one row for each target, with the rows, repeats and tokens placed, the share
    asked, the same scaled to the sources that exist, the share reached and the tokens there are; a target without rows reports zeros. A target without a subtype takes the whole source
    but for subtypes that the same mix lists on their own. Null tokens count 0, a null cap is 1, a null share 0. Rows
    without an id or source take no part.
    """
    spark = rows.sparkSession
    settings = targets.select("mix_name", "source", "source_subtype", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"), label(F.col("source")).alias("src"), label(F.col("source_subtype")).alias("sub")).collect()  # a table of settings
    settings = sorted(settings, key=lambda r: tuple("" if x is None else x for x in r[:3]))
    wanted = [(i, *r) for i, r in enumerate(settings) if r.mix_name is not None and r.source is not None]
    base = written(
        rows.select("id", label(F.col("source")).alias("src"), F.coalesce(label(F.col("source_subtype")), F.lit("")).alias("sub"), F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
        .where("id is not null and src is not null")
    )
    schema = "target int, mix_name string, source string, source_subtype string, share double, cap int, src string, sub string"
    named = spark.createDataFrame(wanted, schema)
    # which target each (source, subtype) belongs to, in each mix
    strata = base.groupBy("src", "sub").agg(F.sum("tokens").alias("size"), F.count("*").alias("n"))
    own = named.select("mix_name", "target", F.col("src").alias("t_src"), F.col("sub").alias("t_sub"))
    fits = strata.join(F.broadcast(own), (F.col("src") == F.col("t_src")) & (F.col("t_sub").isNull() | (F.col("t_sub") == F.col("sub"))))
    chosen = written(fits.groupBy("mix_name", "src", "sub", "size", "n").agg(F.max_by("target", F.struct(F.col("t_sub").isNotNull(), -F.col("target"))).alias("target")))
    sizes = {r[0]: (int(r[1]), int(r[2])) for r in chosen.groupBy("target").agg(F.sum("size"), F.sum("n")).collect()}

    plan, slot_rows = [], []
    for name in dict.fromkeys(w[1] for w in wanted):
        live = [w for w in wanted if w[1] == name and w[4] > 0 and w[5] > 0 and sizes.get(w[0], (0, 0))[0] > 0]
        if not live:
            continue
        scale = sum(w[4] for w in live)
        total = min(sizes[w[0]][0] * w[5] / (w[4] / scale) for w in live)
        slots = max(LEAST_SLOTS, int(-(-total // SLOT_TOKENS)))
        at = 0.0
        for w in live:
            share = w[4] / scale
            plan.append((w[0], name, share * total, at, at + share if w is not live[-1] else 2.0, sizes[w[0]][0], slots, w[5]))
            at += share
        slot_rows.append((name, slots))
    intervals = F.broadcast(spark.createDataFrame(plan, "target int, mix_name string, need double, low double, high double, size bigint, slots bigint, cap int"))
    slots = spark.createDataFrame(slot_rows, "mix_name string, slots bigint")
    parts = max(1, sum(n for _, n in slot_rows) // ROWS_A_SLICE)
    longest = max([n for _, n in slot_rows], default=1)
    schedule = (
        spark.range(longest).withColumnRenamed("id", "slot").join(F.broadcast(slots), F.col("slot") < F.col("slots")).drop("slots")
        .withColumn("u", (F.col("slot") + 1) * GOLDEN - F.floor((F.col("slot") + 1) * GOLDEN))
        .join(intervals.select("mix_name", "target", "low", "high"), "mix_name")
        .where("u >= low and u < high")
        .select("mix_name", "target", "slot")
    )
    in_order = F.floor(F.col("slot") / F.lit(max(1, -(-longest // parts))))
    schedule = written(running_total(schedule, ["target"], ["slot"], F.lit(1), "k", parts, key=in_order))
    given = {r[0]: r[1] for r in schedule.groupBy("target").agg(F.count("*")).collect()}
    blocks = F.broadcast(spark.createDataFrame([(p[0], p[2], p[5], given.get(p[0], 1), p[6]) for p in plan], "target int, need double, size bigint, blocks bigint, cap int"))

    hashed = base.join(chosen.select("src", "sub", "target"), ["src", "sub"]).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint"))
    count = max(1, sum(n for _, n in sizes.values()) // ROWS_A_SLICE)
    streams = running_total(hashed, ["target"], ["h", "id"], F.col("tokens"), "before", count, key=F.floor(F.col("h") / F.lit(float(2**60 // count + 1))))
    repeated = (
        streams.join(blocks, "target")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.least(F.col("cap"), F.greatest(F.lit(1), F.ceil(F.col("need") / F.col("size")).cast("int"))) - 1)))
        .withColumn("at", F.col("repeat_no") * F.col("size") + F.col("before"))
        .where(F.col("at") + F.col("tokens") / 2 <= F.col("need"))  # the row at the end goes to its nearer edge
        .withColumn("k", F.least(F.floor(F.col("at") * F.col("blocks") / F.col("need")), F.col("blocks") - 1))
        .withColumn("offset_in_slot", F.floor(F.col("at") - F.col("k") * F.col("need") / F.col("blocks")).cast("bigint"))
    )
    placed = (
        repeated.join(schedule, ["target", "k"])
        .join(F.broadcast(named.select("target", "source", "source_subtype")), "target")
        .select("mix_name", "slot", "offset_in_slot", "source", "source_subtype", "id", "repeat_no", "tokens", "target")
    )
    by_target = placed.groupBy("target").agg(F.count("*").alias("rows"), (F.max("repeat_no") + 1).alias("most_repeats"), F.sum("tokens").alias("tokens"))
    there = spark.createDataFrame([(t, s, n) for t, (s, n) in sizes.items()], "target int, tokens_there bigint, rows_there bigint")
    scaled = spark.createDataFrame([(p[0], p[2] / sum(x[2] for x in plan if x[1] == p[1])) for p in plan], "target int, scaled double")
    reached = named.join(by_target, "target", "left").join(there, "target", "left").join(scaled, "target", "left")
    of_mix = by_target.join(named.select("target", "mix_name"), "target").groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    zero = lambda c, kind="bigint": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    report = reached.join(of_mix, "mix_name", "left").select(
        "mix_name", "source", "source_subtype", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"),
        zero("rows_there"), zero("tokens_there"), zero("rows"), zero("most_repeats", "int"), zero("tokens"),
        F.round(F.coalesce(F.col("scaled"), F.lit(0.0)), 6).alias("scaled_share"), F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("reached_share"),
    )
    return placed.drop("target"), report


def sized_rows(df: DataFrame, id_col: str, source_col: str, subtype_col: str, *id_arrays: str) -> DataFrame:
    """(id, source, source_subtype, tokens): the size of a row is the length of its id arrays, null arrays counting 0."""
    total = sum((F.greatest(F.size(c), F.lit(0)) for c in id_arrays), F.lit(0))
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(subtype_col).alias("source_subtype"), total.alias("tokens"))
