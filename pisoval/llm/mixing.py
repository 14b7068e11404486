"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

Documents fall into 4,096 cells of their source by a hash of id and text; runs of 2^n cells form blocks of about the same number of
words in every source. Full passes take every block of a source; the rest of its target is drawn from the start of one more
permutation of its blocks, and the block in which that ends gives the documents of the best of 16 permutations of its
own. All block draws are then dealt out to output shards: the quotas of the sources are split exactly in two, again and again, each
time by a multivariate hypergeometric draw, and every shard takes the next blocks of a permutation, so draws are disjoint. Only the
tables of sources, cells and blocks are small; documents meet them once, by (source, cell), so that a source with most of the
rows is spread over its cells.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: Most takes of a document, weights in turn, permutations tried for the last block, hex digits of a cell.
MOST, WEIGHTS, TRIES, DIGITS = 3, 3, 16, 3
#: Largest plan that is broadcast, and what one of its rows takes at the most beside its source's name.
PLAN_BYTES, ROW_BYTES = 64 << 20, 320


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _digest(id_col: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("~")), F.lit("|"), F.coalesce(text, F.lit("~"))))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _cell(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("int")


def _targets(cells: DataFrame) -> DataFrame:
    """(k, source_size, target, passes, rest), one row a source: every source by weight, none above its cap."""
    sizes = cells.groupBy("k").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    order = Window.orderBy(F.col("k") == "n", "k")
    fill = Window.orderBy("full_at", "k")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = sizes.withColumn("weight", 1 + (F.row_number().over(order) - 1) % WEIGHTS) \
        .withColumn("full_at", MOST * F.col("source_size") / F.col("weight")) \
        .withColumn("total", F.sum("source_size").over(Window.partitionBy())) \
        .withColumn("capped", F.sum(MOST * F.col("source_size")).over(fill) - MOST * F.col("source_size")) \
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(rest))
    # The first source, by how soon its cap binds, that the water doesn't reach gives the level of all after it.
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "k", "level"))).over(Window.partitionBy())
    level = level.withColumn("target", F.least(F.col("source_size") * MOST * F.lit(1.0), first["level"] * F.col("weight")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return level.withColumn("passes", F.least(passes, F.lit(MOST)).cast("int")) \
        .select("k", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), "total", "docs")


def _draws(blocks: DataFrame) -> DataFrame:
    """Blocks as drawn: (k, block, pass, part). part: only documents up to a cut are taken."""
    order = Window.partitionBy("k").orderBy("turn", "block")
    ranked = blocks.withColumn("turn", F.md5(F.concat_ws("|", "k", "block", "passes"))) \
        .withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    last = F.when(F.col("upto") <= F.col("rest"), F.array(F.struct(F.col("passes").alias("pass"), F.lit(False).alias("part")))) \
        .when(F.col("before") < F.col("rest"), F.array(F.struct(F.col("passes").alias("pass"), F.lit(True).alias("part")))) \
        .otherwise(F.filter(F.array(F.struct(F.col("passes").alias("pass"), F.lit(True).alias("part"))), lambda x: F.lit(False)))
    full = F.transform(F.filter(F.sequence(F.lit(0), F.lit(MOST)), lambda x: x < F.col("passes")),
                       lambda x: F.struct(x.alias("pass"), F.lit(False).alias("part")))
    return ranked.select("k", "block", (F.col("rest") - F.col("before")).alias("left"), F.explode(F.concat(full, last)).alias("d")) \
        .select("k", "block", "left", F.col("d.pass").alias("pass"), F.col("d.part").alias("part"))


def _hypergeometric(total: str, good: str, n: str, u: str) -> str:
    """SQL of one draw: how many of `n` taken from `total` are among the `good`, by inverse distribution within 8 standard
    deviations and 8 more of the mode (beyond lies less than a double can tell)."""
    low, high = f"greatest(0L, {n} + {good} - {total})", f"least({good}, {n})"
    mode = f"cast(floor(({n} + 1.0D) * ({good} + 1.0D) / ({total} + 2.0D)) as bigint)"
    wide = (f"cast(8 * sqrt({n} * 1.0D * {good} / greatest({total}, 1L) * ({total} - {good}) / greatest({total}, 1L) * ({total} - {n})"
            f" / greatest({total} - 1, 1L)) + 8 as bigint)")
    start, end = f"least({high}, greatest({low}, {mode} - {wide}))", f"least({high}, {mode} + {wide})"
    steps = f"sequence({start}, greatest({start}, {end}))"
    ratio = f"(({good} - x) * 1.0D * ({n} - x)) / ((x + 1.0D) * greatest({total} - {good} - {n} + x + 1, 1L))"
    mass = f"aggregate({steps}, named_struct('p', 1.0D, 's', 0.0D), (b, x) -> named_struct('p', b.p * {ratio}, 's', b.s + b.p)).s"
    return (f"aggregate({steps}, named_struct('p', 1.0D, 's', 0.0D, 'at', {start}, 'goal', {mass} * {u}), (b, x) -> named_struct("
            f"'p', b.p * {ratio}, 's', b.s + b.p, 'at', if(b.s < b.goal, x, b.at), 'goal', b.goal)).at")


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, k, quota, start) from quotas (k, quota): every shard's exact number of blocks of each source, and where they
    begin in the source's permutation. Shards differ by one block at the most."""
    tree = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("k", "quota"))).alias("quota"), F.coalesce(F.sum("quota"), F.lit(0)).alias("t")) \
        .select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "quota", "t")
    span = 1
    while span < shards:
        span *= 2
        place = "cast(floor({} * t / %d) as bigint)" % shards
        tree = tree.withColumn("mid", F.expr("cast((low + high) / 2 as int)")) \
            .withColumn("n", F.expr(f"if(high - low < 2, 0L, {place.format('mid')} - {place.format('low')})"))
        u = f"((pmod(xxhash64({seed}L, low, high, s.k), 9007199254740992L) + 0.5D) / 9007199254740992.0D)"
        draw = _hypergeometric("a.total", "s.quota", "a.n", u)
        tree = tree.withColumn("taken", F.expr(
            "aggregate(quota, named_struct('n', n, 'total', aggregate(quota, 0L, (z, q) -> z + q.quota), 'out', cast(array() as array<bigint>)),"
            f" (a, s) -> transform(array({draw}), x -> named_struct('n', a.n - x, 'total', a.total - s.quota, 'out', concat(a.out, array(x))))[0]).out"))
        tree = tree.withColumn("left", F.expr("zip_with(quota, taken, (q, x) -> named_struct('k', q.k, 'quota', x))")) \
            .withColumn("right", F.expr("zip_with(quota, taken, (q, x) -> named_struct('k', q.k, 'quota', q.quota - x))")) \
            .withColumn("child", F.expr("if(high - low < 2, array(named_struct('low', low, 'high', high, 'quota', quota)), array("
                                        "named_struct('low', low, 'high', mid, 'quota', left), named_struct('low', mid, 'high', high, 'quota', right)))")) \
            .select(F.explode("child").alias("c"), "t").select("c.low", "c.high", "c.quota", "t")
        tree = cut_lineage(tree)
    leaves = tree.select(F.col("low").alias("shard"), F.explode("quota").alias("q")).select("shard", "q.k", "q.quota")
    return leaves.withColumn("start", F.sum("quota").over(Window.partitionBy("k").orderBy("shard")) - F.col("quota"))


def plan_mix(documents: DataFrame, shards: int) -> DataFrame:
    """Takes of every (source key, cell): (k, cell, source_size, target, takes, cut_try, cut_at). documents: k, d (digest), size."""
    cells = documents.groupBy("k", _cell(F.col("d")).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    cells = cut_lineage(cells)
    sources = cut_lineage(_targets(cells))
    # Blocks hold about the words of 1/64 of a shard, and of 64 documents at least; a source's blocks are runs of 2^n cells.
    want = F.greatest(F.col("total") / (64.0 * shards), 64.0 * F.col("source_size") / F.col("docs"), F.lit(1.0))
    width = F.least(F.lit(4 * DIGITS), F.greatest(F.lit(0), F.round(F.log2(F.lit(float(16 ** DIGITS)) * want / F.greatest("source_size", F.lit(1)))))).cast("int")
    sources = sources.withColumn("run", F.pow(F.lit(2.0), width).cast("int"))
    cells = cut_lineage(cells.join(sources.drop("docs"), "k").withColumn("block", F.floor(F.col("cell") / F.col("run")).cast("int")))
    blocks = cells.groupBy("k", "block", "passes", "rest").agg(F.sum("words").alias("words"))
    draws = cut_lineage(_draws(blocks))
    ranked = draws.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(F.md5(F.concat_ws("|", F.lit("d"), "k", "block", "pass")), "block", "pass")) - 1)
    quotas = split_quotas(draws.groupBy("k").agg(F.count("*").alias("quota")), shards)
    places = quotas.where("quota > 0").select("shard", "k", F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("at"))
    dealt = ranked.join(places, ["k", "at"]).groupBy("k", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "part"))).alias("takes"))
    # The last block of a source: of 16 orders, the one and the place in it that come nearest to what is left.
    ends = cells.join(draws.where("part").select("k", "block", "left"), ["k", "block"]).select("k", "cell", "left")
    tries = documents.withColumn("cell", _cell(F.col("d"))).join(ends, ["k", "cell"]) \
        .select("k", "d", "size", "left", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("try"))
    tries = tries.withColumn("h", F.md5(F.concat_ws("|", "d", "try")))
    tries = tries.withColumn("sum", F.sum("size").over(Window.partitionBy("k", "try").orderBy("h")))
    cuts = tries.withColumn("off", F.abs(F.col("sum") - F.col("left"))).where("off < left") \
        .groupBy("k").agg(F.min(F.struct("off", "try", "h")).alias("c")).select("k", F.col("c.try").alias("cut_try"), F.col("c.h").alias("cut_at"))
    return cut_lineage(cells.select("k", "cell", "block", "source_size", "target").join(dealt, ["k", "block"], "left").join(cuts, "k", "left")
                       .select("k", "cell", "source_size", "target", "takes", "cut_try", "cut_at"))


def _keyed(id_col: str, source_col: str, text_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [_key(F.col(f"`{source_col}`")).alias("k"), _digest(F.col(f"`{id_col}`"), text).alias("d"), word_count(text).alias("size")]


def _taken(rows: DataFrame, plan: DataFrame, max_bytes: int = PLAN_BYTES) -> DataFrame:
    """rows (k, d, ...) with source_size, target and takes. The plan is broadcast where its measured size allows; else rows shuffle."""
    held = plan.agg(F.sum(F.octet_length("k") + ROW_BYTES)).first()[0] or 0
    met = rows.withColumn("cell", _cell(F.col("d"))).join(F.broadcast(plan) if held <= max_bytes else plan.hint("shuffle_merge"), ["k", "cell"])
    inside = F.md5(F.concat_ws("|", "d", "cut_try")) <= F.col("cut_at")
    takes = F.filter("takes", lambda x: ~x["part"] | F.coalesce(inside, F.lit(False)))
    takes = F.transform(takes, lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard")))
    return met.withColumn("takes", takes).drop("cell", "cut_try", "cut_at")


def mix_sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = 16,
              max_bytes: int = PLAN_BYTES) -> DataFrame:
    """(id, size, source_size, target, takes), one row for each of df, by the same mix as `mix_documents`; texts are read once and
    go into no shuffle."""
    narrow = cut_lineage(df.select(F.col(f"`{id_col}`").alias("id"), *_keyed(id_col, source_col, text_col)))
    return _taken(narrow, plan_mix(narrow.drop("id"), shards), max_bytes).select("id", "size", "source_size", "target", "takes")


def mix_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = 16,
                  max_bytes: int = PLAN_BYTES) -> DataFrame:
    """df's rows in one struct `row`, with size, source_size, target and takes: array<struct<pass, shard>>, one entry each time
    the mix takes the document, null or empty if it doesn't.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...; all together take as many words as there are. A target above
    3 times its source's words stops there, and the others share the excess by weight. Taken words differ from the target by
    less than the smallest step that 16 orders of one block's documents allow. Null texts have size 0 and are never more than
    company; equal rows are taken alike, so the result doesn't depend on the order of rows; other columns ride along. Rows stay
    where they are unless the plan of sources and cells measures more than max_bytes.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_keyed(id_col, source_col, text_col))
    narrow = cut_lineage(row.select("k", "d", "size"))
    return _taken(row, plan_mix(narrow, shards), max_bytes).select("row", "size", "source_size", "target", "takes", "d")


def mixed_rows(df: DataFrame, shards: int = 16, **columns: str) -> DataFrame:
    """df's rows as often as the mix takes them, dealt out by shard and shuffled within it."""
    mixed = mix_documents(df, shards=shards, **columns).select("row", "d", F.explode("takes").alias("t"))
    mixed = mixed.withColumn("order", F.md5(F.concat_ws("|", F.lit("o"), "d", "t.pass")))
    # A shard is dealt over several tasks by the start of the order, so its size doesn't bind one task.
    return mixed.repartition("t.shard", F.substring("order", 1, 1)).sortWithinPartitions("t.shard", "order").select("row.*")
