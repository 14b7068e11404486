"""Large JSON documents, split at the elements of their arrays.

A document is read in pieces that end with a closing brace, which lets the reader deal one file over many tasks. Whether a piece
starts within a string, and how deep, follows from all that lies before it: each split tells how it changes both for either
answer, the answers are put together over the few splits of a file, and each split is then cut into items on its own. Items are the
elements of containers at depth two, and what lies around these containers. Only an item that a split's border cuts is put together
across tasks; the listings themselves are never shuffled.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.lookup import lookup
from ..session import cut_lineage
from .listings import ENVELOPE_KEYS, is_wrapped, lines_of, parse_values

# An escape inside a string, or a character of structure.
_TOKEN = re.compile(r'\\.|["{}\[\],]', re.S)
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}
SPLIT = ["file", "split"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split, size): text up to each closing brace, without it."""
    texts = spark.read.text(path, lineSep="}")
    return lines_of(texts.select("value", "_metadata")).withColumn("size", F.col("_metadata.file_size"))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, str]]:
    """(keys, text with its brace) of each piece; the text is column 0."""
    for b in batches:
        yield from zip(zip(*(b.column(i).to_pylist() for i in range(1, 1 + n_keys))), (t + "}" for t in b.column(0).to_pylist()))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split changes the state: quotes' parity, change of depth if it starts outside (0) or inside (1) a string."""
    found: dict[tuple, list] = {}
    for key, text in _runs(batches, 3):
        s = found.setdefault(key, [0, 0, 0, 0, ""])
        s[3] += len(text.encode("utf-8", "surrogatepass"))
        s[4] = s[4] or text.strip()[:1]
        quote = s[0]
        for t in _TOKEN.findall(text):
            if t == '"':
                quote ^= 1
            elif t in _STEP:
                s[1 + quote] += _STEP[t]
        s[0] = quote
    cols = list(zip(*[(*k, *s) for k, s in found.items()])) or [()] * 8
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["file", "split", "size", "odd", "out", "inside", "bytes", "first"]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _states(pieces: DataFrame) -> DataFrame:
    """(file, split, depth, quoted, closed): the state in which each split starts; an array counts as if an object held it."""
    own = pieces.select("value", *SPLIT, "size").mapInArrow(
        _summaries, "file string, split long, size long, odd int, out long, inside long, bytes long, first string")
    # One task may hold several runs of a split only if the reader cut it, which it doesn't; splits without a row change nothing.
    file = W.partitionBy("file")
    before = file.orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    quoted = own.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    quoted = quoted.withColumn("step", F.when(F.col("quoted") == 0, F.col("out")).otherwise(F.col("inside")))
    opening = F.first(F.when(F.col("first") != "", F.col("first")), True).over(file.orderBy("split").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    shift = F.when(opening == "[", 1).otherwise(0)
    # Bytes read, one for each brace: one too many where no brace ends the file. A mark of three bytes may lead it.
    spare = F.sum("bytes").over(file) - F.col("size")
    return cut_lineage(quoted.select(*SPLIT, (shift + F.coalesce(F.sum("step").over(before), F.lit(0))).cast("int").alias("depth"),
                         F.col("quoted").cast("int").alias("quoted"), spare.isin(0, -3).alias("closed"),
                         (F.col("split") == F.max("split").over(file)).alias("last")))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut splits into items: `shell` text around containers, `open` where a split's border cuts the item's end."""
    names = ["file", "split", "place", "shell", "open", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    key = None
    rows: list[tuple] = []
    part: list[str] = []
    place = depth = quoted = 0
    held = None  # a split's newest piece waits, as the last one of a file may have no brace

    def end(shell: bool, open_: bool = False) -> None:
        nonlocal place
        rows.append((key[0], key[1], place, shell, open_, "".join(part)))
        part.clear()
        place += 1

    def scan(text: str) -> None:
        nonlocal depth, quoted
        since = 0
        for m in _TOKEN.finditer(text):
            t = m.group()
            if t == '"':
                quoted ^= 1
            elif quoted or len(t) > 1:
                continue
            elif t == ",":
                if depth == 2:
                    part.append(text[since:m.start()])
                    end(False)
                    since = m.end()
            else:
                depth += _STEP[t]
                if _STEP[t] > 0 and depth == 2:
                    part.append(text[since:m.end()])
                    end(True)
                    since = m.end()
                elif _STEP[t] < 0 and depth == 1:
                    part.append(text[since:m.start()])
                    end(False)
                    since = m.start()
        part.append(text[since:])

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()

    def finish() -> None:
        if key is not None:
            scan(held[:-1] if key[5] and not key[4] else held)
            end(depth < 2, True)

    for now, text in _runs(batches, 6):
        if now != key:
            finish()
            key, place, depth, quoted, held = now, 0, now[2], now[3], None
        if held is not None:
            scan(held)
        held = text
        if len(rows) >= 2000:
            yield from flush()
    finish()
    yield from flush()


def document_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, shell, text) of every item; places rise through a file without gaps."""
    pieces = _pieces(spark, path)
    marked = lookup(pieces.select("value", *SPLIT), _states(pieces), SPLIT)
    cut = cut_lineage(marked.select("value", *SPLIT, "depth", "quoted", "closed", "last").mapInArrow(
        _items, "file string, split long, place long, shell boolean, open boolean, text string"))
    ends = cut.groupBy(*SPLIT).agg(F.count_if(~F.col("open")).alias("__ends"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    shifts = ends.select(*SPLIT, F.coalesce(F.sum("__ends").over(before), F.lit(0)).alias("__shift"))
    placed = lookup(cut, shifts, SPLIT).select("file", "split", F.col("place") == 0, "open", (F.col("place") + F.col("__shift")).alias("at"), "shell", "text")
    placed = placed.toDF("file", "split", "leads", "open", "place", "shell", "text")
    at_border = F.col("leads") | F.col("open")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda p: p["text"])
    # Two items a split at the most, so a group holds as many rows as an item has splits.
    glued = placed.filter(at_border).groupBy("file", "place").agg(F.bool_or("shell").alias("shell"), F.array_join(parts, "").alias("text"))
    return placed.filter(~at_border).select("file", "place", "shell", "text").unionByName(glued)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, row_id, raw VARIANT) from JSON documents of any size; each file is one batch.

    Same rows as from documents read whole: envelopes are unwrapped, a document without one is one listing, a broken document is
    one row without a value. A file without a character has no row; a byte order mark is skipped. An element, and a document without an envelope, is one row,
    so these must fit a task; arrays need not.
    """
    items = document_items(spark, path)
    # What lies around containers, with each container's place in it: as few rows as the outermost object has containers.
    shells = items.filter("shell").select("file", "place", "text")
    order = W.partitionBy("file").orderBy("place")
    bounds = cut_lineage(shells.withColumn("next", F.lead("place").over(order)))
    holders = bounds.filter("next IS NOT NULL").select("file", F.col("place").alias("holder"), "next", F.substring(F.rtrim("text"), -1, 1).alias("kind"))
    by_file = holders.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("holder", "next", "kind"))).alias("holders"))
    elements = lookup(items.filter("NOT shell"), by_file, ["file"])
    mine = F.expr("filter(holders, h -> h.holder < place AND place < h.next)[0]")
    elements = elements.withColumn("mine", mine).select(
        "file", "place", "text", F.col("mine.holder").alias("holder"), F.col("mine.kind").alias("kind"),
        ((F.trim(F.translate("text", "\r\n\t", "   ")) == "") & (F.col("mine.next") - F.col("mine.holder") == 2)).alias("blank"))
    wrapped = F.when(F.col("kind") == "{", F.concat(F.lit("[{"), "text", F.lit("}]"))).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    parsed = parse_values(elements.withColumn("value", wrapped)).drop("value").withColumn(
        "own", F.expr("try_variant_get(doc, '$', 'array<variant>')")).withColumn("raw", F.get("own", 0))
    state = cut_lineage(parsed.groupBy("file").agg(F.bool_and(F.coalesce(F.size("own") == 1, F.lit(False)) | F.col("blank")).alias("sound"),
                                       F.collect_set(F.when(F.col("blank"), F.col("holder"))).alias("blanks")))
    stand_in = F.when(F.col("next").isNull() | F.array_contains("blanks", F.col("place")), F.lit("")).when(
        F.substring(F.rtrim("text"), -1, 1) == "{", F.concat(F.lit('"'), "place", F.lit('":0'))).otherwise(F.col("place").cast("string"))
    outline = lookup(bounds, state, ["file"]).withColumn("blanks", F.coalesce("blanks", F.array().cast("array<bigint>")))
    outline = outline.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("text", stand_in).alias("t")))), lambda p: p["t"]), "").alias("value"),
        F.coalesce(F.bool_and("sound"), F.lit(True)).alias("sound"))
    outline = parse_values(outline).drop("value")
    kind = F.schema_of_variant("doc")
    first = [F.expr(f"try_variant_get(doc, '$.{k}', 'array<bigint>')") for k in ENVELOPE_KEYS]
    held = F.when(kind.startswith("ARRAY"), F.expr("try_variant_get(doc, '$', 'array<bigint>')")).when(kind.startswith("OBJECT"), F.coalesce(*first))
    alone = ~F.coalesce(kind.startswith("ARRAY") | is_wrapped(), F.lit(False))
    ways = outline.select("file", (F.col("sound") & F.col("doc").isNotNull()).alias("sound"), held.alias("held"), alone.alias("alone"))
    ways = cut_lineage(ways.select("file", F.when(~F.col("sound"), "none").when(F.col("alone"), "one").when(F.col("held").isNull(), "none").otherwise("many").alias("way"),
                       F.when(F.size("held") > 0, F.col("held")[0]).alias("chosen")))
    many = lookup(parsed, ways, ["file"]).filter((F.col("way") == "many") & (F.col("holder") == F.col("chosen")) & ~F.col("blank"))
    many = many.select(F.col("file").alias("batch_id"), (F.col("place") - F.col("holder") - 1).alias("row_id"), "raw")
    none = ways.filter("way = 'none'").select(F.col("file").alias("batch_id"), F.lit(0).cast("long").alias("row_id"), F.lit(None).cast("variant").alias("raw"))
    single = lookup(items, ways, ["file"]).filter("way = 'one'").groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("place", "shell", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p, i: F.concat(
        F.when((i > 0) & ~p["shell"] & ~F.coalesce(F.get(F.col("parts"), i - 1)["shell"], F.lit(True)), F.lit(",")).otherwise(F.lit("")), p["text"])), "")
    single = parse_values(single.select("file", joined.alias("value"))).select(
        F.col("file").alias("batch_id"), F.lit(0).cast("long").alias("row_id"), F.col("doc").alias("raw"))
    return many.unionByName(single).unionByName(none)
