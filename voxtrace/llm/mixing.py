"""Mixing sources to target weights, with DataFrame functions only.

Every source is cut into blocks of about ``block_docs`` documents by a hash of the id. Its target
is met by whole passes over its blocks plus a draw of further blocks in permuted order; the last
block drawn is filled document by document, to within half the smallest document left. A
splitting tree hands the drawn blocks to output shards: at each node the quotas of all sources
are halved by a multivariate hypergeometric draw, so every shard holds a fair mix and no
block twice. Inside a shard, documents are ordered by a hash.

Defined results: a null text has size 0; null is a source of its own, after all others; documents
of one source with the same id are taken or left together; a source without words has target 0
and its documents are not taken, nor is anything when the table is empty; a very long text is one
document like others, and further columns of documents stay, but none may be named as in ``MIX_COLUMNS``. All draws come from
hashes of ``seed``, so a rerun gives the same mix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No document, and so no source, is taken more often than this.
MOST = 3
BLOCK_DOCS = 1024
#: Words of an output shard, at most on average.
SHARD_WORDS = 1 << 24
#: Names that a mixed table adds or uses on the way: input columns may not have them.
MIX_COLUMNS = (
    "size", "source_size", "target", "shards", "taken", "copy", "shard", "position", "source_no", "_source", "_block",
    "_blocks", "_passes", "_extra", "_part", "_shards", "_no", "_id", "_fits",
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its number in code point order, size, weight and target.

    The level is the largest quotient of words still to share by weight still open when sources
    stop in the order of their limit per weight; a target is weight times level, or the limit.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    numbered = by_source.withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    ).withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("source_no") - 1) % len(weights) + 1))
    limited = numbered.withColumn("limit", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = limited.withColumn("level", shared / open_weight)
    return (
        levelled.withColumn("level", F.max("level").over(whole))
        .withColumn(
            "target",
            F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level")),
        )
        .drop("level", "limit")
    )


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times and computes it once."""
    return F.transform(F.array(value), use)[0]


def _log_factorial(n: Column) -> Column:
    """Logarithm of n!, less a constant: Stirling's series eight places up, where it is exact to 1e-12."""
    low = F.lit(1.0)
    for step in range(1, 9):
        low = low * (n + step)
    z = n + F.lit(9.0)
    return (z - 0.5) * F.log(z) - z + 1 / (12 * z) - 1 / (360 * z * z * z) - F.log(low)


def hypergeometric(total: Column, marked: Column, chosen: Column, u: Column) -> Column:
    """Marked units among ``chosen`` of ``total``, at the quantile ``u`` of their distribution.

    The weights of the counts around the mean are summed until they reach ``u``; those further off than
    twelve standard deviations weigh less than a double can tell. So the work grows with the deviation,
    not with the units.
    """

    def weight(f: Column, k: Column) -> Column:
        left = f["total"] - f["marked"] - f["chosen"] + k
        return -sum((_log_factorial(x) for x in (f["marked"] - k, f["chosen"] - k, left)), _log_factorial(k))

    def around(f: Column) -> Column:
        first = F.greatest(F.lit(0).cast("long"), f["chosen"] + f["marked"] - f["total"], f["mid"] - f["reach"])
        last = F.least(f["chosen"], f["marked"], f["mid"] + f["reach"])
        return _let(
            F.struct(weight(f, f["mid"]).alias("top"), first.alias("first"), last.alias("last")),
            lambda g: _let(
                F.transform(F.sequence(g["first"], g["last"]), lambda k: F.exp(weight(f, k) - g["top"])),
                lambda weights: F.least(g["last"], g["first"] + below(weights)),
            ),
        )

    def below(weights: Column) -> Column:
        """How many leading weights together stay within u of their sum."""
        goal = u * F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"), goal.alias("goal"))
        return F.aggregate(
            weights,
            start,
            lambda s, x: F.struct(
                (s["sum"] + x).alias("sum"),
                (s["n"] + (s["sum"] + x <= s["goal"]).cast("long")).alias("n"),
                s["goal"].alias("goal"),
            ),
        )["n"]

    share = marked / total
    deviation = F.sqrt(chosen * share * (1 - share) * (total - chosen) / F.greatest(total - 1, F.lit(1)))
    facts = F.struct(
        total.alias("total"), marked.alias("marked"), chosen.alias("chosen"),
        F.floor(chosen * share).cast("long").alias("mid"), (F.ceil(12 * deviation) + 12).cast("long").alias("reach"),
    )
    return F.when(total > 0, _let(facts, around)).otherwise(F.lit(0).cast("long"))


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source_no, quota) to (shard, source_no, first, last): disjoint ranges of each source's draws.

    One row holds a node of the tree, with one number per source. The left half takes its units of
    one source after another, each time a hypergeometric draw from the units and left places still
    open; together that is the multivariate hypergeometric law.
    """
    tree = quotas.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("source_no", "quota"))), lambda x: x["quota"]
        ).alias("units")
    ).select(F.lit(0).cast("long").alias("node"), "units")

    def left_of(node: Column, units: Column) -> Column:
        total = F.aggregate(units, F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(
            total.alias("rest"),
            F.floor((total + 1) / 2).cast("long").alias("free"),
            F.array().cast("array<long>").alias("left"),
        )

        def source(state: Column, quota: Column) -> Column:
            u = _uniform(F.lit(seed), node, F.size(state["left"]))
            return _let(
                hypergeometric(state["rest"], quota, state["free"], u),
                lambda taken: F.struct(
                    (state["rest"] - quota).alias("rest"),
                    (state["free"] - taken).alias("free"),
                    F.concat(state["left"], F.array(taken)).alias("left"),
                ),
            )

        return F.aggregate(units, start, source)["left"]

    for _ in range(levels):
        halves = tree.withColumn("left", left_of(F.col("node") + F.lit(1), F.col("units")))
        tree = halves.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.col("left").alias("units")),
                    F.struct(
                        (F.col("node") * 2 + 2).alias("node"),
                        F.zip_with("units", "left", lambda a, b: a - b).alias("units"),
                    ),
                )
            ).alias("half")
        ).select("half.node", "half.units")
    leaves = tree.select(
        (F.col("node") - F.lit((1 << levels) - 1)).cast("int").alias("shard"),
        F.posexplode("units").alias("place", "quota"),
    )
    along = Window.partitionBy("source_no").orderBy("shard")
    return leaves.select("shard", (F.col("place") + 1).alias("source_no"), "quota").select(
        "shard",
        "source_no",
        (F.sum("quota").over(along) - F.col("quota")).alias("first"),
        F.sum("quota").over(along).alias("last"),
    )


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    block_docs: int = BLOCK_DOCS,
    shard_words: int = SHARD_WORDS,
    seed: int = 17,
    keep_text: bool = True,
) -> DataFrame:
    """All documents with size, source_size, target, shards (one output shard for each time the
    document is taken, empty if it is not) and taken (words).

    ``keep_text=False`` returns only doc_id and source beside these.
    """
    sized = documents.withColumn("size", word_count(F.col("text")))
    narrow = stage(sized.select("doc_id", "source", "size"), "mix_sizes")
    sources = stage(source_targets(narrow, weights, most), "mix_sources")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    levels = max(1, (words // shard_words).bit_length())
    sources = sources.select(
        F.col("source").alias("_source"),
        "source_no",
        "source_size",
        "target",
        F.ceil(F.col("docs") / block_docs).cast("long").alias("_blocks"),
        passes.cast("long").alias("_passes"),
        (F.col("target") - passes * F.col("source_size")).alias("_extra"),
    )

    def blocked(rows: DataFrame) -> DataFrame:
        return rows.join(sources, rows["source"].eqNullSafe(sources["_source"]), "left").withColumn(
            "_block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("_blocks"))
        )

    rows = blocked(narrow)
    order = Window.partitionBy("source_no").orderBy(
        F.xxhash64(F.lit(seed + 1), F.col("source_no"), F.col("_block")), "_block"
    )
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        rows.groupBy("source_no", "_block", "_passes", "_extra")
        .agg(F.sum("size").alias("_words"))
        .withColumn("_rank", F.row_number().over(order).cast("long") - 1)
        .withColumn("_before", F.sum("_words").over(upto) - F.col("_words"))
        .withColumn("_count", F.count("*").over(Window.partitionBy("source_no")))
        .withColumn("_part", (F.col("_before") < F.col("_extra")) & (F.col("_before") + F.col("_words") > F.col("_extra")))
        .withColumn("_drawn", F.col("_before") + F.col("_words") <= F.col("_extra"))
    )
    blocks = stage(blocks, "mix_blocks")
    drawn = blocks.withColumn("_drawn", (F.col("_drawn") & (F.col("_extra") > 0)) | F.col("_part"))
    quotas = drawn.groupBy("source_no").agg(
        (F.max(F.col("_passes") * F.col("_count")) + F.sum(F.col("_drawn").cast("long"))).alias("quota")
    )
    ranges = split_quotas(quotas, levels, seed + 2)
    draws = drawn.withColumn(
        "_turn",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.col("_passes") + F.col("_drawn").cast("long"))
        ),
    ).where("_turn < _passes + cast(_drawn as long)")
    draws = draws.withColumn("_place", F.col("_turn") * F.col("_count") + F.col("_rank"))
    # a draw meets the few ranges that share its stretch of the source, each as long as a range on average
    stretches = quotas.select("source_no", F.greatest(F.lit(1), F.ceil(F.col("quota") / (1 << levels))).alias("_long"))
    draws = draws.join(stretches, "source_no").withColumn("_stretch", F.floor(F.col("_place") / F.col("_long")))
    ranges = ranges.where("first < last").join(stretches, "source_no").withColumn(
        "_stretch",
        F.explode(F.sequence(F.floor(F.col("first") / F.col("_long")), F.floor((F.col("last") - 1) / F.col("_long")))),
    )
    placed = draws.join(ranges.drop("_long"), ["source_no", "_stretch"]).where("_place >= first and _place < last")
    shards = stage(
        placed.groupBy("source_no", "_block", "_part", "_passes").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_turn", "shard"))), lambda x: x["shard"]
            ).alias("_shards")
        ),
        "mix_shards",
    )

    # the one block of a source that is drawn in part: in permuted order, what still fits; then
    # again, for documents that may be taken once more; at last the smallest that is left, if the
    # sum comes nearer to the target with it
    part = blocks.where("_part").select(
        "source_no", "_block", "_passes", (F.col("_extra") - F.col("_before")).alias("_room")
    )
    units = (
        rows.select("source_no", "_block", "doc_id", "size")
        .join(part, ["source_no", "_block"])
        .groupBy("source_no", "_block", "_passes", "_room", "doc_id")
        .agg(F.sum("size").alias("size"))
        .where("size > 0")
    )
    filled = units.groupBy("source_no", "_block", "_passes", "_room").agg(
        F.array_sort(
            F.collect_list(F.struct(F.xxhash64(F.lit(seed + 3), "doc_id").alias("turn"), "doc_id", "size"))
        ).alias("all")
    )
    state = F.struct(F.col("_room").alias("room"), F.filter("all", lambda x: F.lit(False)).alias("fit"))
    for turn in range(1, most + 1):
        state = F.aggregate(
            "all",
            state,
            lambda s, x: F.when(
                (x["size"] <= s["room"]) & (F.col("_passes") + turn <= most),  # noqa: B023
                F.struct((s["room"] - x["size"]).alias("room"), F.concat(s["fit"], F.array(x)).alias("fit")),
            ).otherwise(s),
        )
    filled = filled.withColumn("_state", state)
    unused = F.array_except("all", "_state.fit")
    least = F.array_min(F.transform(unused, lambda x: F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"))))
    filled = filled.withColumn("_least", least).select(
        F.col("source_no").alias("_no"),
        F.explode(
            F.concat(
                F.transform("_state.fit", lambda x: x["doc_id"]),
                F.when(F.col("_least.size") < 2 * F.col("_state.room"), F.array("_least.doc_id")).otherwise(
                    F.transform(F.filter("all", lambda x: F.lit(False)), lambda x: x["doc_id"])
                ),
            )
        ).alias("_id"),
    )
    filled = stage(filled.groupBy("_no", "_id").agg(F.count("*").cast("int").alias("_fits")), "mix_filled")

    result = blocked(sized if keep_text else narrow).join(
        shards.drop("_passes"), ["source_no", "_block"], "left"
    )
    result = result.join(
        filled,
        (F.col("source_no") == F.col("_no"))
        & F.col("doc_id").eqNullSafe(F.col("_id")),
        "left",
    )
    whole = F.slice("_shards", F.lit(1), F.col("_passes").cast("int"))
    more = F.array_repeat(F.element_at("_shards", -1), F.coalesce("_fits", F.lit(0)))
    none = F.array().cast("array<int>")
    return (
        result.withColumn(
            "shards",
            F.when(F.col("_shards").isNull(), none)
            .when(F.coalesce("_part", F.lit(False)), F.concat(whole, more))
            .otherwise(F.col("_shards")),
        )
        .withColumn("taken", F.col("size") * F.size("shards"))
        .drop(
            "_block", "_blocks", "_passes", "_extra", "_source", "source_no", "_part", "_shards",
            "_no", "_id", "_fits",
        )
    )


def shard_rows(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: a row for each time a document is taken, its shards together and in order."""
    taken = mixed.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards")
    taken = taken.withColumn("position", F.xxhash64(F.lit(seed), F.col("shard"), F.col("copy"), F.col("doc_id")))
    return taken.repartition("shard").sortWithinPartitions("shard", "position", "doc_id")
