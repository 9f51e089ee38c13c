"""Repeated byte strings by suffix arrays and longest-previous-factor arrays.

A byte string of ``length`` that stands twice must hold the same anchor (its
smallest hashed ``gram``-byte string) at the same place, so only texts around
anchors that stand twice need suffix sorting:

1. Anchors of every window are found by a sliding minimum, and those that stand
   twice anywhere are counted in buckets.
2. Consecutive windows with one anchor form a segment.  Segments with the same
   anchor and text fall together in a grouped count; an anchor all of whose
   segments are one text is settled by that count.
3. Different segments around one anchor are sorted as suffixes, to the depth of
   ``length`` bytes.  In suffix order the previous and the next smaller position
   of a suffix are where its longest previous factor stands; its length is the
   smaller of the common prefixes on the way there.  A window whose factor
   reaches ``length`` stands before; the mirrored array (positions from the end)
   gives the longest next factors, which find the first copies.  An anchor with
   very many segments is split by what stands beside it.
4. Windows of repeated segments, back at all their occurrences, merge into
   spans of removed bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import (
    BUCKET_ITEMS,
    bucket_blobs,
    joined,
    lists,
    materialize,
    offsets,
    packed_texts,
    prefix_hash,
    range_hash,
    raw_texts,
    repeated_filter,
    runs_of_key,
    slices,
    spread_join,
    top_bits,
    unpacked,
    with_row_id,
)

GRAM = 64
#: Bits of the filter that holds the anchors that stand twice, at least and at most (32 MB): it may be broadcast at any
#: size.  Beyond about 10**8 anchors it passes more that stand once, which costs rows of segments, never results.
FILTER_BITS = 20, 28
#: Anchors with more different segments than this are split by the bytes beside them.
SPLIT_KINDS = 512
#: Bytes of segments sorted together, unless one anchor has more.
SORT_BYTES = 1 << 17
#: Bytes of text that are searched for anchors together, and of a piece of a longer text; below 2**24.
SLICE_BYTES = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def segments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, place of the anchor, anchor hash, segment hash) of every segment, by place.

    Windows are the ``length``-byte strings inside one text; data has under 2**24 bytes.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    place = np.arange(len(data) - gram + 1)
    grams = range_hash(prefix, place, place + gram)
    key = (grams & ~_LOW) | place.astype(np.uint64)
    # Smallest key among the grams of each window: minimum over growing powers of two.
    width, have = length - gram + 1, 1
    least = key
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - have : width - have + len(key) - width + 1])
    anchor = (least & _LOW).astype(np.int64)
    room = np.diff(bounds) - length + 1
    valid = np.zeros(len(data) + 1, np.int64)
    fit = room > 0
    np.add.at(valid, bounds[:-1][fit], 1)
    np.add.at(valid, (bounds[:-1] + room)[fit], -1)
    window = np.flatnonzero(np.cumsum(valid[:-1])[: len(anchor)] > 0)
    if not len(window):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = anchor[window]
    fresh = np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]
    # Texts stand side by side: the first window of a text starts a segment as well.
    fresh |= np.isin(window, bounds[:-1][fit])
    head = np.flatnonzero(fresh)
    first, count, where = window[head], np.diff(np.r_[head, len(window)]), at[head]
    text = np.searchsorted(bounds, first, side="right") - 1
    whole = range_hash(prefix, first, first + count + length - 1)
    return text, first, count, where, grams[where], whole ^ ((where - first).astype(np.uint64) << np.uint64(48))


def _facts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rid, ids, text = batch.columns
        size = [len(x) for x in raw_texts(text)]
        yield pa.RecordBatch.from_arrays([rid, ids, pa.array(size, pa.int64())], ["rid", "id", "n"])


def _anchor_blobs(length: int, gram: int, buckets: int):
    """Per bucket and partition: the different anchors, and whether each stood twice already."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in stream:
            for batch in _slices(whole):
                for data, bounds, _ in _pieces(batch, length):
                    anchor = segments(data, bounds, length, gram)[4]
                    held.append(anchor)
                    n += len(anchor)
                if n > BUCKET_ITEMS:
                    yield bucket_blobs(np.concatenate(held), buckets)
                    held, n = [], 0
        if n:
            yield bucket_blobs(np.concatenate(held), buckets)

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices for :func:`_pieces`: a text above the slice size stands alone, without the empty ones before it."""
    for part in slices(batch, SLICE_BYTES):
        ends = offsets(part.column(part.num_columns - 1))
        if part.num_rows > 1 and ends[-1] - ends[0] > SLICE_BYTES:
            long = int(np.argmax(np.diff(ends)))
            yield part.slice(0, long)
            yield part.slice(long, 1)
            part = part.slice(long + 1)
        if part.num_rows:
            yield part


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts of a slice for :func:`segments`: (data, bounds, offset of the piece inside its text).

    A text above the slice size goes in pieces that overlap, so no window is lost.
    """
    data, bounds = joined(batch.column(batch.num_columns - 1))
    limit = SLICE_BYTES + length
    if len(bounds) > 2 or len(data) <= limit:
        yield data, bounds, 0
        return
    for at in range(0, len(data) - length + 1, limit - length + 1):
        piece = data[at : at + limit]
        yield piece, np.array([0, len(piece)]), at


def _segment_rows(length: int, gram: int, sent, size: int):
    """(rid, text) to the segments whose anchor passes the filter."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        for whole in stream:
            for batch in _slices(whole):
                rid = batch.column(0).to_numpy()
                for data, bounds, shift in _pieces(batch, length):
                    text, first, count, where, anchor, segment = segments(data, bounds, length, gram)
                    bit = top_bits(anchor, size)
                    hit = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    # Occurrences of one segment in one text are one row.
                    hit = hit[np.lexsort((first[hit], segment[hit], anchor[hit], text[hit]))]
                    text, first, anchor, segment, where = text[hit], first[hit], anchor[hit], segment[hit], where[hit]
                    same = (text[1:] == text[:-1]) & (anchor[1:] == anchor[:-1]) & (segment[1:] == segment[:-1])
                    head = np.flatnonzero(np.r_[True, ~same]) if len(hit) else hit
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rid[text[head]]),
                            pa.array(anchor[head].view(np.int64)),
                            pa.array(segment[head].view(np.int64)),
                            pa.array(count[hit][head].astype(np.int32)),
                            pa.array((where - first)[head].astype(np.int32)),
                            lists(first - bounds[text] + shift, np.r_[head, len(hit)]),
                        ],
                        ["rid", "anchor", "segment", "windows", "place", "starts"],
                    )

    return run


def _segment_texts(length: int, gram: int):
    """(rid, packed, wanted) to one row per wanted segment with its bytes; two for those of a split anchor.

    A window has half of its other bytes before the anchor or half behind it,
    and equal windows have the same; so windows of a split anchor meet by the
    anchor with that half.
    """
    half = (length - gram) // 2

    def key_of(raw: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for rid, raw, wanted in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for w in wanted:
                    start, windows, place = w["start"], w["windows"], w["start"] + w["place"]
                    if not w["split"]:
                        parts = [(w["anchor"], 0, windows)]
                    else:
                        cut = min(max(place - half - start + 1, 0), windows)
                        parts = [(key_of(b"<" + raw[place - half : place + gram]), 0, cut)] if cut else []
                        if cut < windows:
                            parts.append((key_of(b">" + raw[place : place + gram + half]), cut, windows - cut))
                    for key, shift, n in parts:
                        begin = start + shift
                        rows.append((key, w["anchor"], w["segment"], w["n"], rid, begin, shift, n, raw[begin : begin + n + length - 1]))
            kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["key", "anchor", "segment", "n", "rid", "start", "shift", "windows", "bytes"],
            )

    return run


def truncated_ranks(data: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ranks of the ``depth``-byte strings at the wanted places among each other, by prefix doubling (depth >= 8).

    Also the ranks of shorter strings at all places, as (length, ranks).
    """
    padded = np.r_[data, np.zeros(depth, np.uint8)].astype(np.uint64)
    n = len(data)
    rank = np.zeros(n, np.uint64)
    for j in range(8):
        rank = (rank << np.uint64(8)) | padded[j : j + n]
    have, levels = 8, []
    while True:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        levels.append((have, rank))
        if have == depth:
            return rank[wanted], levels
        step = min(have, depth - have)
        base = rank.max(initial=0) + np.uint64(1)
        if have + step == depth:
            key = rank[wanted] * base + np.r_[rank, np.zeros(depth, np.uint64)][wanted + step]
            return np.unique(key, return_inverse=True)[1], levels
        rank = rank * base + np.r_[rank[step:], np.zeros(step, np.uint64)]
        have += step


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the strings at places a and b, ``depth`` at most; all of them lie inside the data."""
    out = np.zeros(len(a), np.int64)
    for size, rank in sorted(levels, key=lambda x: -x[0]):
        for _ in range(1 + (size == levels[0][0])):
            fits = np.flatnonzero(out + size <= depth)
            same = rank[a[fits] + out[fits]] == rank[b[fits] + out[fits]]
            out[fits[same]] += size
    rest = np.flatnonzero(out < depth)
    while len(rest):
        rest = rest[data[a[rest] + out[rest]] == data[b[rest] + out[rest]]]
        out[rest] += 1
        rest = rest[out[rest] < depth]
    return out


def _to_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The smallest common prefix on the way left to the nearest smaller position, 0 without one.

    position: of the suffixes in suffix order; common[i]: of suffixes i - 1 and i.
    All suffixes look left together; one that meets a larger position goes on
    from where that one looks, so a few rounds settle all.
    """
    at, low = np.arange(len(position)) - 1, common.copy()
    low[:1] = 0
    todo = np.flatnonzero(at >= 0)
    todo = todo[position[at[todo]] > position[todo]]
    while len(todo):
        over = at[todo]
        low[todo] = np.minimum(low[todo], low[over])
        at[todo] = at[over]
        todo = todo[at[todo] >= 0]
        todo = todo[position[at[todo]] > position[todo]]
    low[at < 0] = 0
    return low


def longest_previous_factors(order: np.ndarray, position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """LPF of every suffix: the longest prefix it shares with a suffix of smaller position.

    order: the suffixes in suffix order; common: the prefixes neighbours in it
    share (0 first).  The best partner is the previous or the next smaller
    position in suffix order (PSV, NSV).
    """
    own = position[order]
    left = _to_smaller(own, common)
    right = _to_smaller(own[::-1], np.r_[0, common[:0:-1]])[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(left, right)
    return out


def factor_arrays(data: np.ndarray, at: np.ndarray, rid: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factors, longest next factors) of the strings at ``at``, ``depth`` at most.

    rid and start give the positions: text and place in it, not the place in data.
    """
    rank, levels = truncated_ranks(data, depth, at)
    position = np.empty(len(at), np.int64)
    position[np.lexsort((start, rid))] = np.arange(len(at))
    order = np.lexsort((position, rank))
    same = rank[order][1:] == rank[order][:-1]
    common = np.r_[0, np.where(same, depth, 0)] if len(at) else np.zeros(0, np.int64)
    apart = np.flatnonzero(~same) + 1
    common[apart] = common_prefixes(data, levels, at[order[apart - 1]], at[order[apart]], depth)
    last = len(at) - 1
    return longest_previous_factors(order, position, common), longest_previous_factors(order, last - position, common)


def _ranges(flags: np.ndarray, shift: int = 0) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0])) + shift
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RANGE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sort_segments(length: int):
    """Segments with bytes, sorted by key, to the ranges of their windows that are repeated, and repeated before."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        raw = [x.as_buffer() for x in table.column("bytes")]
        windows = table.column("windows").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.r_[0, np.cumsum(windows + length - 1)][:-1]
        count = np.r_[0, np.cumsum(windows)]
        within = np.arange(count[-1]) - np.repeat(count[:-1], windows)
        rid, start = (np.repeat(table.column(c).to_numpy(), windows) for c in ("rid", "start"))
        previous, following = (x >= length for x in factor_arrays(data, np.repeat(at, windows) + within, rid, start + within, length))
        often, shift = table.column("n").to_numpy() > 1, table.column("shift").to_pylist()
        before = [_ranges(previous[a:b], k) for a, b, k in zip(count, count[1:], shift, strict=False)]
        every = [
            [{"a": k, "b": k + int(b - a)}] if twice else _ranges(previous[a:b] | following[a:b], k)
            for twice, a, b, k in zip(often, count, count[1:], shift, strict=False)
        ]
        return pa.RecordBatch.from_arrays(
            [*(table.column(c).combine_chunks() for c in ("anchor", "segment")), pa.array(every, _RANGE), pa.array(before, _RANGE)],
            ["anchor", "segment", "every", "before"],
        )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, table in runs_of_key(stream):
            held.append(table)
            size += table.column("bytes").nbytes
            if size >= SORT_BYTES:
                yield settle(pa.concat_tables(held).combine_chunks())
                held, size = [], 0
        if held:
            yield settle(pa.concat_tables(held).combine_chunks())

    return run


def _placed(cuts: list[dict], length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of repeated windows; a segment's first start may have ranges of its own."""
    for c in cuts:
        for k, start in enumerate(c["starts"]):
            for r in c["head"] if k == 0 and c["head"] is not None else c["ranges"]:
                yield start + r["a"], start + r["b"] + length - 1


def _remove(length: int):
    """(rid, id, packed, n, cuts) to the remaining bytes; cuts are ranges of repeated windows."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rid, ids, packed, n, cuts = batch.columns
            removed, spans, digest, ranges = [], [], [], []
            for raw, cut in zip(unpacked(packed), cuts.to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted(_placed(cut or (), length)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edge = [0, *(x for m in merged for x in m), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                removed.append(len(raw) - len(rest))
                spans.append(len(merged))
                ranges.append([{"a": a, "b": b} for a, b in merged])
                digest.append(hashlib.sha256(rest).hexdigest())
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [rid, ids, n, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(ranges, kind)],
                ["rid", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_first: bool = True, gram: int = GRAM, split_kinds: int = SPLIT_KINDS
) -> DataFrame:
    """Remove the bytes covered by ``length``-byte strings that stand more than once.

    Texts are their UTF-8 bytes; strings do not cross texts, may overlap, and
    are judged on the input.  With ``keep_first`` the first occurrence in table
    order stays, else all occurrences go.  Null and empty texts have no bytes;
    repeated rows are occurrences of their own.  Very long texts are searched in
    overlapping pieces.  An empty table gives an empty result.  ``length`` must be at least ``gram``, and ``gram`` at least 8.

    Returns per row: _rid, id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (hex, of the remaining bytes), spans.
    """
    if not 8 <= gram <= length:
        raise ValueError("8 <= gram <= length is needed")
    spark = docs.sparkSession
    rows = with_row_id(docs).select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    facts = materialize(rows.mapInArrow(_facts, f"rid long, id {kind}, n long"), "sizes")
    total = facts.agg(F.sum("n")).first()[0] or 0
    texts = rows.select("rid", "text")
    buckets = max(8, int(total * 2 / (length - gram + 2)) // BUCKET_ITEMS + 1)

    low, high = FILTER_BITS
    size = min(high, max(low, int(total * 8 / (length - gram + 2)).bit_length()))
    blobs = texts.mapInArrow(_anchor_blobs(length, gram, buckets), "bucket long, blob binary")
    bits = repeated_filter(blobs, size)
    sent = spark.sparkContext.broadcast(bits.tobytes())

    schema = "rid long, anchor long, segment long, windows int, place int, starts array<long>"
    found = materialize(texts.mapInArrow(_segment_rows(length, gram, sent, size), schema), "segments")
    kinds = found.groupBy("anchor", "segment").agg(
        F.sum(F.size("starts")).alias("n"),
        F.count(F.lit(1)).alias("texts"),
        F.min(F.struct("rid", F.element_at("starts", 1).alias("start"))).alias("origin"),
        F.min("windows").alias("windows"),
        F.min("place").alias("place"),
    )
    n = found.count()
    kinds = materialize(kinds, "segment-kinds", n)
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    anchors = materialize(anchors.filter("total > 1").withColumn("anchor_rows", F.col("kinds")), "anchors", n)
    rows_ = anchors.agg(F.sum("kinds")).first()[0] or 0
    judged = materialize(spread_join(kinds, anchors, "anchor", "anchor_rows", rows_, by="segment"), "repeated-segments", n)

    one = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    settled = judged.filter("kinds = 1").select("anchor", "segment", "texts", "origin", one.alias("every"), F.array().cast("array<struct<a:int,b:int>>").alias("before"))
    mixed = judged.filter("kinds > 1")
    wanted = mixed.groupBy(F.col("origin.rid").alias("want_rid")).agg(
        F.collect_list(
            F.struct("anchor", "segment", "n", F.col("origin.start").alias("start"), "windows", "place", (F.col("kinds") > split_kinds).alias("split"))
        ).alias("wanted")
    )
    sources = packed_texts(rows).join(wanted, F.col("rid") == F.col("want_rid")).select("rid", "packed", "wanted")
    pieces = sources.mapInArrow(
        _segment_texts(length, gram),
        "key long, anchor long, segment long, n long, rid long, start long, shift int, windows int, bytes binary",
    )
    sorted_ = (
        pieces.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_sort_segments(length), "anchor long, segment long, every array<struct<a:int,b:int>>, before array<struct<a:int,b:int>>")
    )
    # A segment of a split anchor comes back in two parts; both apply.
    sorted_ = sorted_.withColumnsRenamed({"anchor": "s_anchor", "segment": "s_segment"})
    compared = mixed.join(sorted_, (F.col("anchor") == F.col("s_anchor")) & (F.col("segment") == F.col("s_segment")))
    verdict = settled.unionByName(compared.select("anchor", "segment", "texts", "origin", "every", "before"))
    verdict = verdict.groupBy(F.struct("anchor", "segment").alias("kind")).agg(
        F.max("texts").alias("texts"), F.first("origin").alias("origin"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("every", "before")],
    )
    verdict = materialize(verdict, "verdicts", n)
    keyed = found.select("rid", "starts", "windows", F.struct("anchor", "segment").alias("kind"))
    whole = spread_join(keyed, verdict, "kind", "texts", verdict.agg(F.sum("texts")).first()[0] or 0)
    no_ranges = F.lit(None).cast("array<struct<a:int,b:int>>")
    if keep_first:
        # Every occurrence but the very first stands after an equal one.
        ranges, head = one, F.when(F.col("rid") == F.col("origin.rid"), F.col("before"))
    else:
        ranges, head = F.col("every"), no_ranges
    hits = whole.select("rid", F.struct("starts", ranges.alias("ranges"), head.alias("head")).alias("cut"))
    cuts = hits.groupBy(F.col("rid").alias("cut_rid")).agg(F.collect_list("cut").alias("cuts"))
    known = facts.select(F.col("rid").alias("f_rid"), "id", "n").join(cuts, F.col("f_rid") == F.col("cut_rid"), "left")
    joined_ = packed_texts(rows).join(known, F.col("rid") == F.col("f_rid")).select("rid", "id", "packed", "n", "cuts")
    return joined_.mapInArrow(
        _remove(length), f"rid long, id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"
    ).withColumnRenamed("rid", "_rid")
