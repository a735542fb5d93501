"""Hard negatives by rotated one-bit codes with stored code-vector alignment.

Every vector v is turned by a fixed random rotation and replaced by the signs of its
components: a unit vector c with one bit a component. Two numbers are stored with
the code: the alignment a = <v, c> and the residual r = sqrt(|v|^2 - a^2). As
v = a c + w with w at right angles to c and |w| = r, the score of an anchor q is
a <q, c> + <q, w>, and by Cauchy-Schwarz <q, w> is at most sqrt(|q|^2 - <q, c>^2) r
in magnitude. <q, c> comes from popcounts: the turned anchor is cut to PLANES bits a
component, one AND and popcount for each bit plane, and the cut's length bounds its
error, again by Cauchy-Schwarz. So each pair has an interval that certainly holds its
score (:func:`intervals`). A row whose interval cannot enter the anchor's list is
dropped by it; survivors are scored as integers, so the result is exact.

The mining takes two scans of all rows: the first finds each anchor's positives, the
second, for each positive, the best rows of other labels within its score window.

Scale: the anchors are a stated query set, met with all rows in blocks. Rows are
dealt to blocks of about CELLS components by a hash of their id, are read once into
one task and stay there as integers; anchors stream past them, ANCHORS at a time, so
a task holds one block whatever the number of anchors. Each block gives an anchor's
own best rows, and the lists are merged by a window whose limit Spark applies before
its shuffle. Codes and their alignments are a written table.

Defined results: rows with a null id, a null label, a null vector, a null or
non-finite component, or one of magnitude LIMIT or more (scores might leave 64 bits)
take no part; an empty vector scores 0; only vectors of one length are compared;
ties go to the smaller id; of rows that repeat an id the one of least label, then
least vector in byte order counts; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import store

SCALE, LIMIT = 256, 1 << 16
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SEED, PLANES = 7, 6
#: Components of a block, anchors and rows of one numpy batch.
CELLS, ANCHORS, ROWS = 1 << 23, 256, 4096
#: Share of surviving pairs from which a batch is scored as one product of matrices.
DENSE = 1 / 16

INDEX = "block int, dim int, id bigint, label bigint, v binary, code binary, align float, resid float"
SCAN = f"{INDEX}, kind int, pids array<bigint>, pscores array<bigint>"
FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, score bigint"


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, alignments and residuals of the rows of ``v``."""
    turned = v @ turn.T
    align = np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])
    resid = np.sqrt(np.maximum((v * v).sum(axis=1) - align * align, 0.0))
    return packed(turned >= 0), align, resid


def packed(bits: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words, filled up with zeros."""
    by = np.packbits(bits, axis=1)
    out = np.zeros((by.shape[0], -(-by.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, :by.shape[1]] = by
    return out.view(np.uint64)


@dataclass
class Block:
    """Rows of one block and length, each id once."""
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    code: np.ndarray
    align: np.ndarray
    resid: np.ndarray


@dataclass
class Anchors:
    """A batch of anchors with their turned vectors, cut into bit planes."""
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        dim = self.v.shape[1]
        turned = self.v @ rotation_of(dim).T
        low = turned.min(axis=1, keepdims=True)
        self.step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-12)
        level = np.clip(np.rint((turned - low) / self.step), 0, (1 << PLANES) - 1).astype(np.int64)
        self.planes = [packed(level >> b & 1 == 1) for b in range(PLANES)]
        self.low, self.sum = low, level.sum(axis=1, keepdims=True)
        self.error = np.sqrt(((turned - low - level * self.step) ** 2).sum(axis=1, keepdims=True))
        self.norm = np.sqrt((self.v ** 2).sum(axis=1, keepdims=True))


_TURNS: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    """:func:`rotation`, made once in a worker process for each length."""
    if dim not in _TURNS:
        _TURNS[dim] = rotation(dim)
    return _TURNS[dim]


def intervals(q: Anchors, block: Block, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each anchor with rows a to b."""
    code, dim = block.code[a:b], block.v.shape[1]
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
    in_code = np.zeros((q.ids.size, b - a), dtype=np.int32)
    for bit, plane in enumerate(q.planes):
        for w in range(code.shape[1]):
            in_code += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int32) << bit
    f = np.float32
    along = (q.low.astype(f) * (2 * ones - dim).astype(f) + q.step.astype(f) * (2 * in_code - q.sum).astype(f)) / f(np.sqrt(dim))
    sure = np.maximum(np.abs(along) - q.error.astype(f), 0)
    across = np.sqrt(np.maximum((q.norm ** 2).astype(f) - sure * sure, 0))
    align, resid = block.align[a:b], block.resid[a:b]
    # far above the rounding of the single-precision terms
    slack = f(1e-3) * q.norm.astype(f) * (align + resid) + f(1e-3)
    half = align * q.error.astype(f) + across * resid + slack
    return align * along - half, align * along + half


def exact(q: Anchors, block: Block, a: int, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the surviving pairs, scored as integers."""
    i, j = np.nonzero(may)
    rows = block.v[a:a + may.shape[1]]
    # doubles hold all integers below 2 ** 53
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(q.v).max(initial=0)) * rows.shape[1]
    kind = np.float64 if top < 2 ** 53 else np.int64
    left, right = q.v.astype(kind), rows.astype(kind)
    if i.size > DENSE * may.size:
        return i, j + a, (left @ right.T)[i, j].astype(np.int64)
    score = np.empty(i.size, dtype=np.int64)
    for s in range(0, i.size, 1 << 16):
        e = slice(s, s + (1 << 16))
        score[e] = np.einsum("ij,ij->i", left[i[e]], right[j[e]]).astype(np.int64)
    return i, j + a, score


class Best:
    """The k best (score, id) of each list."""

    def __init__(self, lists: int, k: int):
        self.k, self.size = k, lists
        self.list, self.id, self.score = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(lists, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        at, ids, score = (np.concatenate(x) for x in ((self.list, at), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        rank = np.arange(at.size) - np.searchsorted(at, at)
        keep = rank < self.k
        self.list, self.id, self.score = at[keep], ids[keep], score[keep]
        last = rank == self.k - 1
        self.least[at[last]] = score[last]


def best_positives(q: Anchors, block: Block, k: int) -> Best:
    """Each anchor's k best rows of its own label in the block, but itself."""
    best = Best(q.ids.size, k)
    for a in range(0, block.ids.size, ROWS):
        b = min(a + ROWS, block.ids.size)
        _, upper = intervals(q, block, a, b)
        may = (q.labels[:, None] == block.labels[a:b]) & (q.ids[:, None] != block.ids[a:b]) & (upper >= best.least[:, None])
        i, j, score = exact(q, block, a, may)
        ok = score >= best.least[i]
        best.add(i[ok], block.ids[j[ok]], score[ok])
    return best


def best_negatives(q: Anchors, block: Block, k: int, pscores: np.ndarray, low: int, high: int) -> Best:
    """For each anchor (row) and positive score (column, NaN for none) the k best
    rows of other labels in its window; lists are numbered row by row."""
    n = pscores.shape[1]
    best = Best(q.ids.size * n, k)
    for a in range(0, block.ids.size, ROWS):
        b = min(a + ROWS, block.ids.size)
        lower, upper = intervals(q, block, a, b)
        least = np.fmax(best.least.reshape(-1, n), low / 100 * pscores)
        may = np.zeros(lower.shape, dtype=bool)
        for p in range(n):
            may |= (100 * lower <= high * pscores[:, p, None]) & (upper >= least[:, p, None])
        may &= q.labels[:, None] != block.labels[a:b]
        i, j, score = exact(q, block, a, may)
        for p in range(n):
            ps, at = pscores[i, p], i * n + p
            ok = (low * ps <= 100 * score) & (100 * score <= high * ps) & (score >= best.least[at])
            best.add(at[ok], block.ids[j[ok]], score[ok])
    return best


def prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x): the rows that take part, components as whole numbers."""
    x = F.col("x")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    good = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"))
    return src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & good).select("id", "label", whole.alias("x"))


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """The coded rows, dealt to ``blocks`` blocks by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for dim in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dim))
                for s in range(0, part.num_rows, ROWS):
                    some = part.slice(s, ROWS)
                    v = some.column("x").flatten().to_numpy().reshape(some.num_rows, dim) if dim else np.zeros((some.num_rows, 1))
                    code, align, resid = encode(v.astype(np.float64), rotation_of(max(dim, 1)))
                    yield pa.RecordBatch.from_arrays([
                        some.column("block"), some.column("dim"), some.column("id"), some.column("label"),
                        pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()),
                        pa.array(align.astype(np.float32)), pa.array(resid.astype(np.float32))],
                        ["block", "dim", "id", "label", "v", "code", "align", "resid"])

    src = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("x").alias("dim"), "id", "label", "x")
    return src.mapInArrow(run, INDEX)


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def _scan(index: DataFrame, anchors: DataFrame, blocks: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Every block's own best rows for every anchor: positives, or with the column
    ``pids`` of the anchors, negatives in the windows of their ``pscores``."""
    mining = "pids" in anchors.columns
    none = F.lit(None).cast("array<bigint>")
    extra = [F.col("pids"), F.col("pscores")] if mining else [none.alias("pids"), none.alias("pscores")]
    cols = ["dim", "id", "label", "v", "code", "align", "resid"]
    every = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = index.select("block", *cols, F.lit(0).alias("kind"), none.alias("pids"), none.alias("pscores")).union(
        every.select("block", *cols, F.lit(1).alias("kind"), *extra))

    def answers(block: Block, part: pa.Table, dim: int) -> pa.RecordBatch:
        q = Anchors(part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v").to_pylist(), "<i4").astype(np.float64))
        if not mining:
            best = best_positives(q, block, positives)
            of, pid, ps = best.list, None, None
        else:
            n = positives
            pids = [(x + [None] * n)[:n] for x in part.column("pids").to_pylist()]
            pscores = np.array([(x + [np.nan] * n)[:n] for x in part.column("pscores").to_pylist()], dtype=np.float64).reshape(-1, n)
            best = best_negatives(q, block, negatives, pscores, low, high)
            of, p = best.list // n, best.list % n
            pid, ps = [pids[i][j] for i, j in zip(of.tolist(), p.tolist(), strict=True)], pscores[of, p].astype(np.int64)
        empty = pa.nulls(best.list.size, pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(q.ids[of]), empty if pid is None else pa.array(pid, pa.int64()), empty if ps is None else pa.array(ps),
            pa.array(best.id), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score", "other_id", "score"])

    def once(table: pa.Table) -> pa.Table:
        """The first row of each id; rows are sorted by id."""
        ids = table.column("id").to_numpy()
        return table.filter(pa.array(np.append(True, ids[1:] != ids[:-1])[:ids.size]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held, last = None, None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            mark = np.stack([table.column(c).to_numpy() for c in ("block", "dim", "kind")], axis=1)
            cuts = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mark)], strict=True):
                unit, kind, part = tuple(mark[s, :2].tolist()), mark[s, 2], table.slice(s, e - s)
                if unit != now:
                    now, block, held, last = unit, None, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    rows, held = once(pa.concat_tables(held)), []
                    block = Block(rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v").to_pylist(), "<i4"),
                                  _matrix(rows.column("code").to_pylist(), "<u8"), rows.column("align").to_numpy(), rows.column("resid").to_numpy())
                part = once(part)
                if part.column("id")[0].as_py() == last:
                    part = part.slice(1)
                if block is None or not part.num_rows:
                    continue
                last = part.column("id")[-1].as_py()
                for a in range(0, part.num_rows, ANCHORS):
                    yield answers(block, part.slice(a, ANCHORS), unit[1])

    rows = both.repartition(blocks, "block").sortWithinPartitions("block", "dim", "kind", "id", "label", "v")
    return rows.mapInArrow(run, FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each list, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", is_anchor: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that ``is_anchor`` (a condition on ``id``, the id; every
    hundredth id by default) holds for. A positive is one of an anchor's best
    ``positives`` other rows of its label; its negatives are the best rows of other
    labels whose score is at least ``low`` and at most ``high`` percent of its own."""
    spark = df.sparkSession
    rows = prepared(df, id_col, vector_col, label_col)
    cells = rows.agg(F.sum(F.greatest(F.size("x"), F.lit(1)))).first()[0] or 0
    # enough blocks for all cores; their number changes no result
    blocks = max(-(-cells // CELLS), 2 * spark.sparkContext.defaultParallelism)
    index = store(build_index(rows, blocks), "codes")
    anchors = index.where(F.col("id") % 100 == 0 if is_anchor is None else is_anchor)
    args = (blocks, positives, negatives, low, high)
    own = _first(_scan(index, anchors, *args), ["anchor_id"], positives)
    lists = store(own.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("p")), "positives")
    paired = anchors.join(lists.select(F.col("anchor_id").alias("id"), F.col("p.other_id").alias("pids"), F.col("p.score").alias("pscores")), "id")
    found = _first(_scan(index, paired, *args), ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
