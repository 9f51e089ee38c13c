"""SentencePiece encoding and decoding over a relational lattice.

Units of the corpus (a space mark with the letters after it) are encoded as
relations: all their substrings of bounded length are exploded, an equi-join
with the piece table leaves the lattice's edges, edges are grouped by unit, and
a higher-order ``aggregate`` folds each lattice into pieces.

Two ways bring the pieces back to the texts.  :func:`encode_joined` sends every
different unit through the lattice and joins the result with the units of each
scan partition, which meet the partition's texts in one task.  :func:`encode`
does so for the most frequent units only, a lexicon of fixed size that is
broadcast; other units are folded over the same lattice inside the task that
meets them, short ones side by side as rows of an array.  Both encode every text whole, to the same identifiers.

The fold depends on the model.  A unigram model takes the path of the highest
score (Viterbi).  A byte-pair model is defined by merges in order of score, and
the best path through its lattice is another segmentation, so for it the fold
merges the best adjacent pair, leftmost first, until none is an edge.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import materialize, slices, unpacked, with_row_id

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Units end before a space mark and around line feeds; no piece crosses such an end.
UNIT = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
LEXICON_UNITS = 1 << 16
#: Rarer units are not worth a place in the lexicon.
LEXICON_COUNT = 8
#: Longer units stay out of the lexicon.
LEXICON_CHARS = 24
CACHE_UNITS = 1 << 19
#: Longer units are folded in the task that meets them also when all others are joined: their fold takes quadratic time.
LATTICE_CHARS = 64
#: Characters of texts whose units are looked up together, but for a longer text.
GROUP_CHARS = 1 << 21
#: Units folded side by side at most.
FOLD_UNITS = 1 << 14
#: The rank of two parts that make no piece.
NO_PAIR = np.iinfo(np.int32).max
#: Units whose lattices are grouped together, about.
PART_UNITS = 40_000


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model file."""

    kind: str  # "bpe" or "unigram"
    pieces: dict[str, tuple[int, float]]  # normal pieces: id, score
    first_byte: int  # id of <0x00>, or -1: without byte fallback unknown characters become ``unknown``
    unknown: int
    text: tuple[bytes, ...]  # bytes each id decodes to
    dummy_prefix: bool
    longest: int  # characters of the longest piece

    @classmethod
    def load(cls, path: str = MODEL) -> PieceModel:
        """Read on the driver; the result goes to the executors with the tasks."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without normalisation are supported")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces, text, first_byte, unknown = {}, [], -1, 0
        for i, p in enumerate(proto.pieces):
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                pieces[p.piece] = (i, p.score)
                text.append(p.piece.replace(SPACE_MARK, " ").encode())
            elif p.type == kinds.BYTE:
                first_byte = i if p.piece == "<0x00>" else first_byte
                text.append(bytes([int(p.piece[3:5], 16)]))
            else:
                unknown = i if p.type == kinds.UNKNOWN else unknown
                text.append(b"")
        kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses the end of a unit")
        return cls(kind, pieces, first_byte, unknown, tuple(text), proto.normalizer_spec.add_dummy_prefix, max(map(len, pieces), default=1))

    def single(self, char: str) -> list[int]:
        """Ids of a character that no larger piece takes."""
        if char in self.pieces:
            return [self.pieces[char][0]]
        return [self.first_byte + b for b in char.encode("utf-8", "replace")] if self.first_byte >= 0 else [self.unknown]

    def fold(self, unit: str) -> list[int]:
        """Ids of one unit, in time n log n for a byte-pair model."""
        bounds = self._best_path(unit) if self.kind == "unigram" else self._merges(unit)
        out: list[int] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            out += self.single(unit[a]) if b == a + 1 else [self.pieces[unit[a:b]][0]]
        return out

    def fold_all(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian int32 bytes) of many units; those of a byte-pair model are folded side by side."""
        out: dict[str, bytes] = {}
        side = sorted((u for u in units if self.kind == "bpe" and 0 < len(u) <= LEXICON_CHARS), key=len)
        for i in range(0, len(side), FOLD_UNITS):
            for size, same in itertools.groupby(side[i : i + FOLD_UNITS], len):
                self._merge_rows(list(same), size, out)
        for u in units:
            if u not in out:
                out[u] = np.array(self.fold(u), "<i4").tobytes()
        return out

    @functools.cached_property
    def _pairs(self) -> PairTable:
        return PairTable(self.pieces)

    def _merge_rows(self, units: list[str], size: int, out: dict[str, bytes]) -> None:
        """Merge units of one size, a row each, one pair a row and step; a row has as many parts left as all others."""
        pairs = self._pairs
        part = pairs.symbols("".join(units)).reshape(-1, size)
        row = np.arange(len(units))
        rank, made = pairs.find(part[:, :-1], part[:, 1:])
        while True:
            if size > 1:
                at = rank.argmin(axis=1)  # the leftmost of equals
                live = rank[np.arange(len(row)), at] < NO_PAIR
            else:
                at = live = np.zeros(len(row), bool)
            if not live.all():
                self._put_rows([units[i] for i in row[~live].tolist()], part[~live], out)
                part, rank, made, at, row = part[live], rank[live], made[live], at[live], row[live]
            if not len(row):
                return
            each = np.arange(len(row))
            part[each, at] = made[each, at]
            part, rank, made = _without(part, at + 1), _without(rank, at), _without(made, at)
            size -= 1
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 1)
            i, j = np.r_[left, right], np.r_[at[left] - 1, at[right]]
            rank[i, j], made[i, j] = pairs.find(part[i, j], part[i, j + 1])

    def _put_rows(self, units: list[str], part: np.ndarray, out: dict[str, bytes]) -> None:
        ids, chars = self._pairs.ids[part], self._pairs.chars[part]
        raw, step = ids.astype("<i4").tobytes(), 4 * part.shape[1]
        out.update((u, raw[k * step : (k + 1) * step]) for k, u in enumerate(units))
        for k in np.flatnonzero((ids < 0).any(axis=1)).tolist():
            unit, at, coded = units[k], 0, []
            for i, n in zip(ids[k].tolist(), chars[k].tolist(), strict=True):
                coded += [i] if i >= 0 else self.single(unit[at])
                at += n
            out[unit] = np.array(coded, "<i4").tobytes()

    def _merges(self, unit: str) -> list[int]:
        n = len(unit)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        alive = [True] * (n + 1)
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            mid = after[a]
            if mid < n:
                end = after[mid]
                if end - a <= longest and (edge := pieces.get(unit[a:end])):
                    heapq.heappush(heap, (-edge[1], a, mid, end))

        pieces, longest = self.pieces, self.longest
        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, mid, end = heapq.heappop(heap)
            if not (alive[a] and alive[mid] and after[a] == mid and after[mid] == end):
                continue
            alive[mid] = False
            after[a], before[end] = end, a
            if a:
                offer(before[a])
            offer(a)
        return [i for i in range(n + 1) if alive[i]]

    def _best_path(self, unit: str) -> list[int]:
        n, worst = len(unit), min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        score, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for b in range(1, n + 1):
            for a in range(max(0, b - self.longest), b):
                edge = self.pieces.get(unit[a:b])
                s = score[a] + (edge[1] if edge else worst if b == a + 1 else float("-inf"))
                if s > score[b]:
                    score[b], back[b] = s, a
        out = [n]
        while out[-1]:
            out.append(back[out[-1]])
        return out[::-1]


class PairTable:
    """Pairs of symbols whose texts together are a piece, in a hash table; symbols are the pieces and their characters."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        symbol = {p: i for i, p in enumerate(dict.fromkeys([*pieces, *sorted(set().union(*pieces))]), 1)}
        self.count = len(symbol) + 1  # 0: any other character
        self.ids = np.full(self.count, -1, np.int32)
        self.ids[1 : len(pieces) + 1] = [i for i, _ in pieces.values()]
        self.chars = np.array([1, *map(len, symbol)], np.int32)
        chars = [c for c in symbol if len(c) == 1]
        self.char = np.zeros(max(map(ord, chars), default=0) + 2, np.int32)
        self.char[[ord(c) for c in chars]] = [symbol[c] for c in chars]
        order = {s: i for i, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        found = [
            (symbol[p[:i]] * self.count + symbol[p[i:]], order[s], symbol[p])
            for p, (_, s) in pieces.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol
        ]
        key, rank, made = np.array(found, np.int64).reshape(-1, 3).T
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank, self.made = np.full(1 << bits, NO_PAIR, np.int32), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = left[self.key[slot[left]] < 0]
            self.key[slot[free]] = key[free]  # of several the last stays
            left = left[self.key[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.rank[slot], self.made[slot] = rank, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def symbols(self, text: str) -> np.ndarray:
        return self.char[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), len(self.char) - 1)]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair by score, or NO_PAIR, and the symbol it makes."""
        key = (a.astype(np.int64) * self.count + b).ravel()
        slot = self._slot(key)
        got = self.key[slot]
        other = np.flatnonzero((got != key) & (got >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            got = self.key[slot[other]]
            other = other[(got != key[other]) & (got >= 0)]
        return self.rank[slot].reshape(a.shape), self.made[slot].reshape(a.shape)


def _without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row without its item ``at``."""
    kept = np.ones(rows.shape, bool)
    kept[np.arange(len(rows)), at] = False
    return rows[kept].reshape(len(rows), -1) if len(rows) else rows[:, 1:]


def units_of(text: str, model: PieceModel) -> list[str]:
    marked = text.replace(" ", SPACE_MARK)
    return UNIT.findall(SPACE_MARK + marked if model.dummy_prefix and marked else marked)


def _count_units(model: PieceModel):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(u, n) for u, n in seen.items() if 1 < len(u) <= LEXICON_CHARS]
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["unit", "n"]
            )

        for whole in stream:
            for batch in slices(whole, 4 << 20):
                for text in batch.column(0).to_pylist():
                    seen.update(units_of(text or "", model))
                if len(seen) > CACHE_UNITS:
                    yield flush()
        yield flush()

    return run


def frequent_units(docs: DataFrame, model: PieceModel, text_col: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent units of two characters or more, by counts over all texts."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_units(model), "unit string, n long")
    return counts.groupBy("unit").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEXICON_COUNT).orderBy(F.desc("n"), "unit").limit(limit)


def _part_units(model: PieceModel):
    """(rid, text) to the different units of each scan partition, but single characters and overlong ones."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        done: list[int] = []

        def flush() -> pa.RecordBatch:
            kept = [u for u in seen if 1 < len(u) <= LATTICE_CHARS]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([done[0]] * len(kept), pa.int64()), pa.array(kept, pa.string())], ["part", "unit"])

        for whole in stream:
            for batch in slices(whole, 4 << 20):
                done = done or [batch.column(0)[0].as_py() >> 33]
                for text in batch.column(1).to_pylist():
                    seen.update(units_of(text or "", model))
                if len(seen) > CACHE_UNITS:
                    yield flush()
        if seen:
            yield flush()

    return run


def lattice(units: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, edges): substrings of bounded length that are pieces, as (start, stop, id, score)."""
    spark = units.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in model.pieces.items()], "piece string, id int, score double")
    size = F.char_length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    longest = F.least(F.lit(model.longest), size - F.col("start"))
    parts = starts.select("unit", "start", F.explode(F.sequence(F.lit(1), longest)).alias("size"))
    parts = parts.withColumn("part", F.substring("unit", F.col("start") + 1, F.col("size")))
    # The piece table is the model's vocabulary, whose size is fixed.
    edges = parts.join(F.broadcast(table), F.col("part") == F.col("piece"), "left")
    edge = F.when(F.col("id").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("stop"), "id", "score"))
    return edges.groupBy("unit").agg(F.collect_list(edge).alias("edges"))


def fold_lattice(lattices: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, bounds): the pieces' bounds in characters, folded with ``aggregate``."""
    marked = lattices.selectExpr(
        "unit", "char_length(unit) AS size",
        "map_from_entries(transform(edges, e -> struct(e.start * 1000 + e.stop, e.score))) AS score",
    )
    if model.kind == "bpe":
        # Each step drops the inner bound whose two neighbours span the best piece, the leftmost of equals.
        fold = """aggregate(sequence(1, size - 1), sequence(0, size), (b, k) -> transform(array(array_max(transform(
            slice(b, 2, size(b) - 2),
            (x, i) -> CASE WHEN map_contains_key(score, b[i] * 1000 + b[i + 2])
                           THEN struct(score[b[i] * 1000 + b[i + 2]] AS s, -x AS x) END))),
            m -> CASE WHEN m IS NULL THEN b ELSE filter(b, y -> y != -m.x) END)[0])"""
    else:
        # best[j] is the score of the best path to character j and the bounds on it.
        worst = min((s for _, s in model.pieces.values()), default=0.0) - 10.0
        fold = f"""element_at(aggregate(sequence(1, size), array(struct(0D AS s, array(0) AS b)), (best, j) -> concat(best, array(
            array_max(transform(sequence(greatest(0, j - {model.longest}), j - 1), a -> CASE
                WHEN map_contains_key(score, a * 1000 + j) THEN struct(best[a].s + score[a * 1000 + j] AS s, concat(best[a].b, array(j)) AS b)
                WHEN a = j - 1 THEN struct(best[a].s + {worst}D AS s, concat(best[a].b, array(j)) AS b) END))))), -1).b"""
    return marked.selectExpr("unit", f"{fold} AS bounds")


def build_lexicon(docs: DataFrame, model: PieceModel, text_col: str = "text", limit: int = LEXICON_UNITS) -> dict[str, bytes]:
    """Ids (little-endian int32 bytes) of the frequent units, at most ``limit`` of them, from the relational lattice."""
    folded = fold_lattice(lattice(frequent_units(docs, model, text_col, limit), model), model)
    out = {}
    for unit, bounds in folded.toLocalIterator():
        ids: list[int] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            ids += model.single(unit[a]) if b == a + 1 else [model.pieces[unit[a:b]][0]]
        out[unit] = np.array(ids, "<i4").tobytes()
    return out


def _encode(sent):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = sent.value
        coder, known = _encode_batches(model), dict(lexicon)
        for whole in stream:
            for batch in slices(whole, 4 << 20):
                rid, ids, text = batch.columns
                if len(known) > len(lexicon) + CACHE_UNITS:
                    known = dict(lexicon)
                yield coder(rid, ids, text.to_pylist(), known)

    return run


def unit_ids(units: DataFrame, model: PieceModel) -> DataFrame:
    """(unit, ids): the identifiers of every unit, little-endian int32, from its folded lattice."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for unit, bounds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids: list[int] = []
                for a, b in zip(bounds, bounds[1:], strict=False):
                    ids += model.single(unit[a]) if b == a + 1 else [model.pieces[unit[a:b]][0]]
                out.append(np.array(ids, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["unit", "ids"])

    return fold_lattice(lattice(units, model), model).mapInArrow(run, "unit string, ids binary")


def _encode_parts(model: PieceModel):
    """Rows sorted by (part, rid), a part's units (without rid) before its texts, to coded texts."""
    coder = _encode_batches(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in stream:
            part, rid = batch.column("part").to_numpy(), batch.column("rid")
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if part[a] != now:
                    now, known = part[a], {}
                split = a + rid.slice(a, b - a).null_count
                known.update(zip(batch.column("unit").slice(a, split - a).to_pylist(), batch.column("ids").slice(a, split - a).to_pylist(), strict=True))
                if split < b:
                    texts = [x.decode("utf-8", "surrogatepass") for x in unpacked(batch.column("packed").slice(split, b - split))]
                    yield coder(rid.slice(split, b - split), batch.column("id").slice(split, b - split), texts, known)

    return run


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, chars = [], 0
    for x in texts:
        if group and chars + len(x or "") > GROUP_CHARS:
            yield group
            group, chars = [], 0
        group.append(x or "")
        chars += len(x or "")
    if group:
        yield group


def _encode_batches(model: PieceModel):
    """Coded texts of a batch; ``known`` holds identifiers of units, and takes those of units it lacks up to LEXICON_CHARS."""

    def code(rid, ids, texts: list[str | None], known: dict[str, bytes]) -> pa.RecordBatch:
        coded, at, same = [], [0], []
        for group in _groups(texts):
            split = [units_of(x, model) for x in group]
            new = set().union(*split).difference(known)
            known.update(model.fold_all(new))
            for x, units in zip(group, split, strict=True):
                raw = b"".join(map(known.__getitem__, units))
                coded.append(raw)
                at.append(at[-1] + len(raw) // 4)
                same.append(decode_ids(np.frombuffer(raw, "<i4"), model) == x.replace(SPACE_MARK, " "))
            for u in new:
                if len(u) > LEXICON_CHARS:
                    del known[u]
        tokens = pa.ListArray.from_arrays(pa.array(np.array(at, np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [rid, ids, tokens, pa.array(np.diff(at), pa.int64()), pa.array(same, pa.bool_())], ["rid", "id", "tokens", "n_tokens", "round_trip"]
        )

    return code


def encode_joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """As :func:`encode`, with every different unit of up to ``LATTICE_CHARS`` characters from the relational lattice.

    The units of a scan partition and its texts meet in one task, which holds
    the units once; so a partition must fit an executor, as a scan's does.
    """
    model = PieceModel.load(model_path)
    rows = with_row_id(docs).select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = materialize(rows.select("rid", "text").mapInArrow(_part_units(model), "part long, unit string"), "units")
    # So many parts that a part's edges are grouped in memory.
    parts = max(8, min(found.count() // PART_UNITS + 1, 1 << 16))
    ids = materialize(unit_ids(found.select("unit").repartition(parts, "unit").distinct(), model), "unit-ids").withColumnRenamed("unit", "ids_unit")
    known = found.join(ids, F.col("unit") == F.col("ids_unit")).select("part", F.lit(None).cast("long").alias("rid"), F.lit(None).cast(kind).alias("id"), "unit", "ids", F.lit(None).cast("binary").alias("packed"))
    texts = rows.mapInArrow(_packed_with_id, f"part long, rid long, id {kind}, packed binary")
    texts = texts.select("part", "rid", "id", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("binary").alias("ids"), "packed")
    both = known.unionByName(texts).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("rid"))
    coded = both.mapInArrow(_encode_parts(model), f"rid long, id {kind}, tokens array<int>, n_tokens long, round_trip boolean")
    return coded.withColumnRenamed("rid", "_rid")


def _packed_with_id(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    coder = zstandard.ZstdCompressor(level=3)
    for batch in stream:
        rid, ids, text = batch.columns
        packed = [coder.compress((x or "").encode()) for x in text.to_pylist()]
        part = pa.array(rid.to_numpy() >> 33, pa.int64())
        yield pa.RecordBatch.from_arrays([part, rid, ids, pa.array(packed, pa.binary())], ["part", "rid", "id", "packed"])


def viterbi_units(texts: DataFrame, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """(unit, pieces) of every different unit of up to ``LATTICE_CHARS`` characters: the path of the highest sum of scores.

    The pieces' scores of any model file are taken as those of a unigram model.
    Nulls, empty texts and repeated rows add nothing; single characters are
    their own path.  An empty table gives an empty result.
    """
    model = replace(PieceModel.load(model_path), kind="unigram")
    rows = with_row_id(texts).select(F.col("_rid").alias("rid"), F.col(text_col).cast("string").alias("text"))
    units = rows.mapInArrow(_part_units(model), "part long, unit string").select("unit").distinct()
    folded = fold_lattice(lattice(units, model), model)
    pieces = F.expr("transform(sequence(1, size(bounds) - 1), i -> substring(unit, bounds[i - 1] + 1, bounds[i] - bounds[i - 1]))")
    return folded.select("unit", pieces.alias("pieces"))


def decode_ids(ids: np.ndarray, model: PieceModel) -> str:
    """Text of a sequence of ids; bytes that are no UTF-8 become the replacement character."""
    text = b"".join(map(model.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, lexicon_units: int = LEXICON_UNITS
) -> DataFrame:
    """Encode every text, and decode it again.

    Returns per row: _rid, id, tokens (array<int>), n_tokens, round_trip
    (decoding gives the text back; a space mark in a text reads as a space).
    Null and empty texts have no tokens.  Repeated rows are encoded each; a text
    of any length, also of one word, is encoded whole; an empty table gives an
    empty result.
    """
    model = PieceModel.load(model_path)
    lexicon = build_lexicon(docs, model, text_col, lexicon_units)
    rows = with_row_id(docs).select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    coded = rows.mapInArrow(
        _encode(docs.sparkSession.sparkContext.broadcast((model, lexicon))), f"rid long, id {kind}, tokens array<int>, n_tokens long, round_trip boolean"
    )
    return coded.withColumnRenamed("rid", "_rid")


def decode(tokens: DataFrame, tokens_col: str = "tokens", model_path: str = MODEL) -> DataFrame:
    """``tokens`` with a column ``decoded``: the text of each id list (null: null)."""
    model = PieceModel.load(model_path)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column(batch.schema.get_field_index(tokens_col)).to_pylist()
            text = [None if x is None else decode_ids(np.array(x, np.int64), model) for x in lists]
            rest = [i for i, name in enumerate(batch.schema.names) if name != "decoded"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(text, pa.string())], [*(batch.schema.names[i] for i in rest), "decoded"]
            )

    kept = ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes if c != "decoded")
    return tokens.mapInArrow(run, f"{kept}, decoded string")
