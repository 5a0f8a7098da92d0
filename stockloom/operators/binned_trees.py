"""Regression trees on binned features, grown level by level from sums per node and bin.

The lines are binned once and written in blocks. A level of trees is one job over the blocks: each
task adds up its lines per node and bin, the sums are added over the tasks, and the best
split of each node comes to the driver. No line is moved, and a text is one column of slots,
however many one-or-zero features its slots stand for. The rules are those of Spark's own trees
(``RandomForestRegressor``, ``GBTRegressor``): candidates for thresholds from the same size of sample,
variance as impurity, and pseudo-residuals of twice the error in boosting.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import discard, keep
from .encoding import NO_SLOT, TARGET

MAX_BINS = 128
#: Thresholds are chosen from a sample of about this size, as Spark's trees do.
SAMPLE = MAX_BINS * MAX_BINS
_BLOCK_LINES = 32_768
#: A task reads at least so many blocks and at most so many lines.
_TASK_BLOCKS = 2
_TASK_LINES = 3_000_000
#: The sums that a task holds at a time, for as many trees as fit.
_SUMS_BYTES = 64 << 20
#: Boosting on so many lines is one task's work, of some 22 bytes a line: jobs for each level would take longer.
_ALONE_LINES = 1 << 20
#: Rounds of boosting that are followed anew in each job, and those that Spark alone keeps before they are written.
_ROUNDS_AHEAD, _ROUNDS_KEPT = 8, 48
#: A spread or gain below this share of the sum of squares is rounding.
_ROUNDING = 1e-14

#: Splits often divide few lines alike, and the last digits decide. They are Spark's, too, of companies
#: whose thresholds come from all lines, if lines times slots are no more than this.
_FEW = 4 << 20
#: So many of them are in memory at a time.
_CELLS = 1 << 19
#: An impurity below this is none, as in Spark's trees.
_PURE = 2.0**-52

_BLOCK = "first bigint, bins binary, target binary, numbers binary"
_STATE = "bins binary, target binary, sum binary"
_TREES = "tree int, grown binary"
_SUMS = "tree int, first bigint, sums binary"
_SPLIT = (
    "tree int, node int, n double, total double, feature int, cut int, flipped boolean, "
    "left_n double, left_total double, right_n double, right_total double"
)


@dataclass(frozen=True)
class Settings:
    """``rate`` is for boosting; without it, each tree has its own draw of the lines."""

    trees: int
    depth: int
    least: int
    seed: int = 42
    rate: float | None = None

    def weight(self, tree: int) -> float:
        return self.rate if self.rate is not None and tree > 0 else 1.0


@dataclass(frozen=True)
class Bins:
    """How a line becomes one bin per feature: thresholds of the numbers, slots of the texts."""

    numbers: list[str]
    thresholds: list[np.ndarray]
    texts: list[str]
    slots: list[int]

    @cached_property
    def widths(self) -> list[int]:
        return [len(cuts) + 1 for cuts in self.thresholds] + [k + 1 for k in self.slots]

    @property
    def columns(self) -> list[str]:
        return [f"{c}_scaled" for c in self.numbers] + [f"{c}_slot" for c in self.texts]

    @property
    def kind(self) -> type:
        return np.uint8 if max(self.widths) <= 256 else np.uint16 if max(self.widths) <= 65_536 else np.uint32

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row per feature. What has no slot gets the place after the last one."""
        found = np.empty((len(self.widths), batch.num_rows), self.kind)
        for i, (name, cuts) in enumerate(zip(self.numbers, self.thresholds)):
            found[i] = np.searchsorted(cuts, _numbers(batch, f"{name}_scaled"), side="left")
        for i, (name, k) in enumerate(zip(self.texts, self.slots), len(self.numbers)):
            slot = batch.column(f"{name}_slot").to_numpy(zero_copy_only=False)
            found[i] = np.where(slot == NO_SLOT, k, slot)
        return found


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
    if np.isnan(values).any():
        raise ValueError(f"{name} has missing values")
    return values


class Tree:
    """One tree, nodes numbered by level (the children of i are 2i+1 and 2i+2)."""

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.depth = depth
        self.feature = np.full(size, -1)
        self.cut = np.zeros(size, np.int64)
        self.flipped = np.zeros(size, bool)
        self.n, self.total, self.squares = np.zeros(size), np.zeros(size), np.zeros(size)
        self.closed = np.zeros(size, bool)

    def split(self, start: int, row) -> None:
        """Take over what was found for a node of the level that starts at ``start``."""
        i = start + row["node"]
        self.n[i], self.total[i] = row["n"], row["total"]
        if row["feature"] < 0:
            return
        self.feature[i], self.cut[i], self.flipped[i] = row["feature"], row["cut"], row["flipped"]
        for child, side in ((2 * i + 1, "left"), (2 * i + 2, "right")):
            self.n[child], self.total[child] = row[f"{side}_n"], row[f"{side}_total"]
            if f"{side}_closed" in row:
                self.squares[child], self.closed[child] = row[f"{side}_squares"], row[f"{side}_closed"]

    def open(self, level: int) -> list[int]:
        """The nodes of a level that may be split, by their place in it."""
        start = (1 << level) - 1
        return [j for j in range(1 << level) if level == 0 or (self.feature[(start + j - 1) // 2] >= 0 and not self.closed[start + j])]

    def values(self) -> np.ndarray:
        """The value for each place of the last level: a leaf above it goes on to the left."""
        value = self.total / np.maximum(self.n, 1)
        for i in range((1 << self.depth) - 1):
            if self.feature[i] < 0:
                value[2 * i + 1] = value[i]
        return value[(1 << self.depth) - 1 :]

    def places(self, seen: np.ndarray, n_numbers: int, level: int) -> np.ndarray:
        """Where each line is in a level. Lines of a leaf above it go on to the left."""
        at = np.zeros(seen.shape[1], np.uint8)
        for step in range(level):
            right = np.zeros(seen.shape[1], bool)
            for j in range(1 << step):
                i = (1 << step) - 1 + j
                f = self.feature[i]
                if f < 0:
                    continue
                if f < n_numbers:
                    goes = seen[f] > self.cut[i]
                else:
                    goes = (seen[f] != self.cut[i]) if self.flipped[i] else (seen[f] == self.cut[i])
                right |= goes if step == 0 else goes & (at == j)
            at = (at << 1) | right.view(np.uint8)
        return at


def find_bins(training: DataFrame, n: int, numbers: list[str], texts: list[str], slots: list[int], seed: int) -> Bins:
    if not numbers and not texts:
        raise ValueError("there is no feature to fit on")
    cuts: list[np.ndarray] = []
    if numbers:
        sample = training.select(*[F.col(f"{c}_scaled").cast("double") for c in numbers])
        if n > SAMPLE:
            sample = sample.sample(SAMPLE / n, seed)
        found = sample.toArrow()
        cuts = [thresholds(found.column(f"{c}_scaled").to_numpy(), min(MAX_BINS, n) - 1) for c in numbers]
    return Bins(numbers, cuts, texts, slots)


def thresholds(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds halfway between values, with similar numbers of values between them."""
    values, counts = np.unique(sample[~np.isnan(sample)], return_counts=True)
    halfway = (values[:-1] + values[1:]) / 2
    if len(halfway) <= most:
        return halfway
    stride = counts.sum() / (most + 1)
    reached, wanted, chosen = counts.cumsum(), stride, []
    for i in range(1, len(values)):
        if abs(reached[i - 1] - wanted) < abs(reached[i] - wanted):
            chosen.append(halfway[i - 1])
            wanted += stride
    return np.array(chosen)


def _to_blocks(bins: Bins) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(held: list) -> pa.RecordBatch:
        seen, target, numbers = (np.concatenate(part, axis=-1) for part in zip(*held))
        columns = [[int(numbers[0])], [seen.tobytes()], [target.tobytes()], [numbers.tobytes()]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
            ["first", "bins", "target", "numbers"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            target = _numbers(batch, TARGET)
            if not np.isfinite(target).all():
                raise ValueError(f"{TARGET} is not finite")
            held.append((bins.of(batch), target, batch.column("line_no").to_numpy(zero_copy_only=False).astype(np.int64)))
            n += batch.num_rows
            if n >= _BLOCK_LINES:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    return run


def _poisson() -> np.ndarray:
    """How often a line is drawn, by 16 random bits: Poisson with mean 1."""
    chances = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 20)]))
    return np.searchsorted(chances, (np.arange(65_536) + 0.5) / 65_536).astype(np.float64)


def draws(numbers: np.ndarray, four: int, seed: int) -> np.ndarray:
    """16 random bits of each line for four trees. They depend on the line's number only, so every
    level draws the same lines, wherever they are."""
    with np.errstate(over="ignore"):
        x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x += np.uint64((seed * 0xD1342543DE82EF95 + (four + 1) * 0xDA942042E4DD58B5) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0xD6E8FEB86659FD93)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(32)
    return x.view(np.uint16).reshape(-1, 4)


def _blocks_of(batches: Iterator[pa.RecordBatch], bins: Bins) -> Iterator[tuple]:
    for batch in batches:
        for first, seen, target, numbers in zip(*(batch.column(i) for i in range(4))):
            matrix = np.frombuffer(seen.as_buffer(), bins.kind).reshape(len(bins.widths), -1)
            yield first.as_py(), matrix, np.frombuffer(target.as_buffer(), np.float64), np.frombuffer(numbers.as_buffer(), np.int64)


def _sums(bins: Bins, trees: dict[int, Tree], level: int, settings: Settings):
    """A task's sums for a level of some trees: per node and bin the lines and their target, and
    per node the lines, the target and its square."""
    nodes, n_numbers = 1 << level, len(bins.numbers)
    ends = np.cumsum([nodes * width for width in bins.widths])
    size = int(ends[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {t: np.zeros(2 * size + 3 * nodes) for t in trees}
        least = None
        often = _poisson()
        for first, seen, target, numbers in _blocks_of(batches, bins):
            least = first if least is None else min(least, first)
            places = seen.astype(np.intp)
            bits, four = None, -1
            for t, tree in trees.items():
                if t // 4 != four:
                    four = t // 4
                    bits = draws(numbers, four, settings.seed)
                weight = often[bits[:, t % 4]]
                drawn = weight * target
                at = tree.places(seen, n_numbers, level).astype(np.intp)
                sums = found[t]
                for width, end, place in zip(bins.widths, ends, places):
                    here = place if level == 0 else at * width + place
                    start = end - nodes * width
                    sums[start:end] += np.bincount(here, weight, minlength=nodes * width)
                    sums[size + start : size + end] += np.bincount(here, drawn, minlength=nodes * width)
                for k, what in enumerate((weight, drawn, drawn * target)):
                    sums[2 * size + k * nodes : 2 * size + (k + 1) * nodes] += np.bincount(at, what, minlength=nodes)
        if least is not None:
            for t, sums in found.items():
                columns = [pa.array([t], pa.int32()), pa.array([least], pa.int64()), pa.array([sums.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "first", "sums"])

    return run


def best_splits(sums: np.ndarray, bins: Bins, level: int, least: int) -> list[dict]:
    """The split of each node that takes away most variance; feature -1 where there is none.

    A number's split sends the bins up to the cut to the left. A text's split tells one slot
    from all others, and the side with the smaller mean is the left one.
    """
    nodes = 1 << level
    size = nodes * sum(bins.widths)
    n, total, squares = sums[2 * size :].reshape(3, nodes)
    features, cuts, left_n, left_total, end = [], [], [], [], 0
    for f, width in enumerate(bins.widths):
        start, end = end, end + nodes * width
        count = sums[start:end].reshape(nodes, width)
        value = sums[size + start : size + end].reshape(nodes, width)
        if f < len(bins.numbers):
            left_n.append(count.cumsum(axis=1)[:, :-1])
            left_total.append(value.cumsum(axis=1)[:, :-1])
        else:
            left_n.append(n[:, None] - count[:, :-1])
            left_total.append(total[:, None] - value[:, :-1])
        features += [f] * (width - 1)
        cuts += range(width - 1)
    left_n, left_total = np.concatenate(left_n, axis=1), np.concatenate(left_total, axis=1)
    right_n, right_total = n[:, None] - left_n, total[:, None] - left_total
    fits = (left_n >= least) & (right_n >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(n > 0, total * total / n, 0.0)
        gain = np.where(fits, left_total**2 / left_n + right_total**2 / right_n - base[:, None], -np.inf)
    rows = []
    for j in range(nodes):
        row = {"node": j, "n": float(n[j]), "total": float(total[j]), "feature": -1, "cut": 0, "flipped": False}
        row |= {"left_n": 0.0, "left_total": 0.0, "right_n": 0.0, "right_total": 0.0}
        rounding = _ROUNDING * squares[j]
        best = int(gain[j].argmax()) if features else None
        if best is not None and squares[j] - base[j] > rounding and gain[j, best] > rounding:
            sides = [(left_n[j, best], left_total[j, best]), (right_n[j, best], right_total[j, best])]
            flipped = features[best] >= len(bins.numbers) and sides[0][1] / sides[0][0] > sides[1][1] / sides[1][0]
            (ln, lt), (rn, rt) = sides[::-1] if flipped else sides
            row |= {"feature": features[best], "cut": cuts[best], "flipped": bool(flipped)}
            row |= {"left_n": float(ln), "left_total": float(lt), "right_n": float(rn), "right_total": float(rt)}
        rows.append(row)
    return rows


def _added_up(parts: list[tuple[int, bytes]]) -> np.ndarray:
    """The sums of all tasks, in the order of their lines."""
    found = 0.0
    for _, part in sorted(parts, key=lambda one: one[0]):
        found = found + np.frombuffer(part)
    return found


def _grow(blocks: DataFrame, bins: Bins, trees: dict[int, Tree], settings: Settings) -> None:
    """Grow new trees, a level of as many as fit into a task's memory at a time."""
    for level in range(settings.depth):
        start = (1 << level) - 1
        rest = [t for t, tree in trees.items() if tree.open(level)]
        fit = max(1, _SUMS_BYTES // (16 * (1 << level) * (sum(bins.widths) + 2)))
        for some in (rest[i : i + fit] for i in range(0, len(rest), fit)):
            part = {t: trees[t] for t in some}
            sums = blocks.mapInArrow(_sums(bins, part, level, settings), _SUMS)
            if len(part) == 1:
                # One tree's sums are a few kilobytes a task.
                found = _added_up([(row.first, row.sums) for row in sums.collect()])
                rows = [{"tree": some[0], **row} for row in best_splits(found, bins, level, settings.least)]
            else:
                rows = sums.groupBy("tree").applyInArrow(_best_of(bins, level, settings.least), _SPLIT).collect()
            for row in rows:
                if row["node"] in trees[row["tree"]].open(level):
                    trees[row["tree"]].split(start, row)


def _best_of(bins: Bins, level: int, least: int) -> Callable[[pa.Table], pa.Table]:
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in _SPLIT.split(", "))])

    def run(parts: pa.Table) -> pa.Table:
        tree = parts.column("tree")[0].as_py()
        sums = _added_up(list(zip(parts.column("first").to_pylist(), parts.column("sums").to_pylist())))
        return pa.Table.from_pylist([{"tree": tree, **row} for row in best_splits(sums, bins, level, least)], schema)

    return run


def _tasks(training: DataFrame, n: int) -> int:
    """A fit passes over its blocks many times, so they are dealt to all cores, and to more tasks
    where these would be large."""
    cores = training.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n // (_TASK_BLOCKS * _BLOCK_LINES), max(cores, -(-n // _TASK_LINES))))


def fit_trees(training: DataFrame, bins: Bins, settings: Settings, n: int = 0) -> list[Tree]:
    """Fit on ``n`` lines with the features, the target and ``line_no``, by which lines are drawn."""
    columns = [*bins.columns, F.col(TARGET).cast("double").alias(TARGET), F.col("line_no").cast("bigint").alias("line_no")]
    blocks = training.select(*columns).mapInArrow(_to_blocks(bins), _BLOCK)
    blocks = keep(blocks.repartition(tasks) if (tasks := _tasks(training, n)) > 1 else blocks, "tree_blocks")
    trees = {t: Tree(settings.depth) for t in range(settings.trees)}
    _grow(blocks, bins, trees, settings)
    discard(blocks)
    return list(trees.values())


class _Boosted:
    """Lines in boosting: bins, target, and what the trees so far add up to."""

    def __init__(self, bins: Bins, settings: Settings, n: int):
        self.bins, self.settings = bins, settings
        self.few = n <= SAMPLE and n * sum(bins.slots) <= _FEW
        self.most = max(bins.widths) << (settings.depth - 1)

    def of(self, block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen, target, sum_ = block
        sum_ = np.frombuffer(sum_, np.float64)
        kind = np.float64 if len(target) == 8 * len(sum_) else np.float32
        return np.frombuffer(seen, self.bins.kind).reshape(len(self.bins.widths), -1), np.frombuffer(target, kind), sum_

    @staticmethod
    def begun(seen: bytes, target: bytes) -> tuple:
        """A block before the first tree. A target that single precision holds takes half the room."""
        target = np.frombuffer(target, np.float64)
        small = target.astype(np.float32)
        return bytes(seen), (small if (small == target).all() else target).tobytes(), np.zeros(len(target)).tobytes()

    def sums(self, blocks: Iterable, ahead: list, tree: Tree, level: int, number: int) -> np.ndarray | None:
        """Per node and bin the lines, their pseudo-residuals and the squares; then, if few, per node and
        slot, those of the lines without it. Each sum is taken line by line, as Spark's trees do, so
        that equal sets of lines have equal sums."""
        widths, nodes, most = self.bins.widths, 1 << level, self.most
        size = nodes * (sum(widths) + self.few * sum(self.bins.slots))
        found = None
        for block in blocks:
            seen, target, sum_ = self.of(self.moved_on(block, ahead))
            found = np.zeros((3, size)) if found is None else found
            n = len(sum_)
            # What was found so far goes before the block's lines.
            where, errors, squares = np.empty(most + n, np.intp), np.empty(most + n), np.empty(most + n)
            np.subtract(target, sum_, out=errors[most:])
            if number:
                errors[most:] *= 2
            np.multiply(errors[most:], errors[most:], out=squares[most:])
            at = tree.places(seen, len(self.bins.numbers), level).astype(np.intp) if level else None
            end = 0
            for width, place in zip(widths, seen):
                cells = nodes * width
                start, end, first = end, end + cells, most - cells
                where[first:most] = np.arange(cells)
                if level:
                    np.multiply(at, width, out=where[most:])
                    where[most:] += place
                else:
                    where[most:] = place
                found[0, start:end] += np.bincount(where[most:], minlength=cells)
                for row, weights in ((1, errors), (2, squares)):
                    weights[first:most] = found[row, start:end]
                    found[row, start:end] = np.bincount(where[first:], weights[first:], minlength=cells)
            for j in range(nodes if self.few else 0):
                lines = np.flatnonzero(at == j) if level else np.arange(n)
                self._add_lacks(found, end, j, nodes, seen[:, lines], errors[most + lines], squares[most + lines])
        return found

    def _add_lacks(self, found: np.ndarray, end: int, j: int, nodes: int, seen: np.ndarray, *weights: np.ndarray) -> None:
        """To a node's sums of the lines without a slot."""
        for k, places in zip(self.bins.slots, seen[len(self.bins.numbers) :]):
            cells = np.s_[end + j * k : end + (j + 1) * k]
            # One column more: numpy adds up row by row only where there are several columns.
            slots, step = np.arange(k + 1), max(1, _CELLS // (k + 1))
            for first in range(0, len(places), step):
                lacks = places[first : first + step, None] != slots
                found[0, cells] += np.count_nonzero(lacks[:, :k], axis=0)
                rows = np.empty((len(lacks) + 1, k + 1))
                for row, weight in enumerate(weights, 1):
                    np.multiply(lacks, weight[first : first + step, None], out=rows[1:])
                    rows[0, :k], rows[0, k] = found[row, cells], 0.0
                    found[row, cells] = rows.sum(axis=0)[:k]
            end += nodes * k

    def moved_on(self, block: tuple, ahead: list[tuple[Tree, int]]) -> tuple:
        """The block with what more trees add to its sum."""
        if not ahead:
            return block
        seen, _, sum_ = self.of(block)
        for tree, number in ahead:
            added = tree.values()[tree.places(seen, len(self.bins.numbers), tree.depth)]
            sum_ = sum_ + self.settings.weight(number) * added
        return *block[:2], sum_.tobytes()

    def grown(self, sums: Callable[[Tree, int, int], np.ndarray], number: int) -> Tree:
        tree = Tree(self.settings.depth)
        for level in range(tree.depth):
            start, open_ = (1 << level) - 1, tree.open(level)
            if not open_:
                break
            rows = boosted_splits(sums(tree, level, number), self.bins, tree, level, self.settings.least, self.few)
            for j in open_:
                tree.split(start, rows[j])
        return tree

    def in_one_task(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All trees of a company whose lines one task reads."""
        blocks = [
            self.begun(seen.as_py(), target.as_py()) for batch in batches for seen, target in zip(batch.column("bins"), batch.column("target"))
        ]
        for number in range(self.settings.trees if blocks else 0):
            tree = self.grown(lambda *about: self.sums(blocks, [], *about), number)
            blocks = [self.moved_on(block, [(tree, number)]) for block in blocks]
            columns = [pa.array([number], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "grown"])


def _spread(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.where(n > 0, (squares - (total * total) / n) / n, 0.0)


def boosted_splits(sums: np.ndarray, bins: Bins, tree: Tree, level: int, least: int, few: bool) -> list[dict]:
    """The split of each node with the largest gain, by the steps of ``GBTRegressor``: of splits with
    equal gain the first is taken, so sums and gains are made in the same order as there."""
    nodes, start = 1 << level, (1 << level) - 1
    features, cuts, lefts, rights, flips, end = [], [], [], [], [], 0
    without, whole = nodes * sum(bins.widths), None
    for f, width in enumerate(bins.widths):
        here = sums[:, nodes * end : nodes * (end + width)].reshape(3, nodes, width)
        end += width
        before = here.cumsum(axis=2)
        total = before[:, :, -1:]
        whole = total if whole is None else whole
        if f < len(bins.numbers):
            left, right = before[:, :, :-1], total - before[:, :, :-1]
            flipped = np.zeros(left.shape[1:], bool)
        else:
            has = here[:, :, :-1]
            k = width - 1
            lacks = sums[:, without : without + nodes * k].reshape(3, nodes, k) if few else whole - has
            without += nodes * k
            with np.errstate(divide="ignore", invalid="ignore"):
                means = [np.where(side[0] > 0, side[1] / side[0], np.inf) for side in (lacks, has)]
            flipped = means[1] < means[0]
            left = np.where(flipped, has, lacks)
            right = (lacks + has) - left
        features += [f] * (width - 1)
        cuts += range(width - 1)
        for held, what in ((lefts, left), (rights, right), (flips, flipped)):
            held.append(what)
    own = np.s_[start : start + nodes]
    rows = []
    if features:
        (ln, lt, ls), (rn, rt, rs) = np.concatenate(lefts, axis=2), np.concatenate(rights, axis=2)
        flipped = np.concatenate(flips, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = _spread(tree.n[own], tree.total[own], tree.squares[own]) if level else _spread(*(a[:, 0] + b[:, 0] for a, b in ((ln, rn), (lt, rt), (ls, rs))))
            left_spread, right_spread, n = _spread(ln, lt, ls), _spread(rn, rt, rs), ln + rn
            gain = spread[:, None] - ln / n * left_spread - rn / n * right_spread
            gain = np.where((ln >= least) & (rn >= least) & (gain >= 0), gain, -np.inf)
        best = gain.argmax(axis=1)
    for j in range(nodes):
        # What the split above said of the node, or at the root what its first split adds up to.
        own_sums = (tree.n[start + j], tree.total[start + j]) if level else (whole[0, 0, 0], whole[1, 0, 0])
        row = {"node": j, "n": float(own_sums[0]), "total": float(own_sums[1]), "feature": -1, "cut": 0, "flipped": False}
        if features and gain[j, (b := int(best[j]))] > 0:
            row |= {"feature": features[b], "cut": cuts[b], "flipped": bool(flipped[j, b])}
            for side, (n, total, squares, spread) in (("left", (ln, lt, ls, left_spread)), ("right", (rn, rt, rs, right_spread))):
                row |= {f"{side}_n": float(n[j, b]), f"{side}_total": float(total[j, b]), f"{side}_squares": float(squares[j, b])}
                row[f"{side}_closed"] = bool(abs(spread[j, b]) < _PURE)
        rows.append(row)
    return rows


def boost_trees(training: DataFrame, bins: Bins, settings: Settings, n: int = 0) -> list[Tree]:
    """Boosted trees on ``n`` lines. Few lines are one task's work; of many, each level of a tree is a job
    over the blocks, which Spark keeps in memory (or on disk) with what the trees add up to."""
    steps = _Boosted(bins, settings, n)
    columns = [*bins.columns, F.col(TARGET).cast("double").alias(TARGET), F.col("line_no").cast("bigint").alias("line_no")]
    blocks = training.select(*columns).mapInArrow(_to_blocks(bins), _BLOCK)
    if n <= _ALONE_LINES:
        grown = blocks.coalesce(1).mapInArrow(steps.in_one_task, _TREES).collect()
        return [pickle.loads(row.grown) for row in sorted(grown, key=lambda row: row.tree)]
    blocks = keep(blocks.select("bins", "target").repartition(_tasks(training, n)), "tree_blocks")
    state = blocks.rdd.map(lambda row: steps.begun(row.bins, row.target)).persist(StorageLevel.MEMORY_AND_DISK)
    before, trees, ahead = None, [], []
    try:
        for number in range(settings.trees):
            tree = steps.grown(lambda *about: _all_sums(state, steps, ahead, about), number)
            trees.append(tree)
            ahead = [*ahead, (tree, number)]
            if before is not None:
                before.unpersist()
                before = None
            if len(ahead) < _ROUNDS_AHEAD or number + 1 == settings.trees:
                continue
            before, state, ahead = state, _moved(state, steps, ahead), []
            if (number + 1) % _ROUNDS_KEPT == 0:
                # What a lost executor held is made again from here on.
                earlier, blocks = blocks, keep(training.sparkSession.createDataFrame(state, _STATE), "tree_blocks")
                discard(earlier)
                state = blocks.rdd.map(lambda row: (bytes(row.bins), bytes(row.target), bytes(row.sum)))
            state.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        state.unpersist()
        if before is not None:
            before.unpersist()
    discard(blocks)
    return trees


def _all_sums(state: RDD, steps: _Boosted, ahead: list, about: tuple) -> np.ndarray:
    """The sums of all tasks, in the order of their parts: one row a task comes to the driver."""
    parts = state.mapPartitions(lambda blocks: [steps.sums(blocks, ahead, *about)]).collect()
    return sum(part for part in parts if part is not None)


def _moved(state: RDD, steps: _Boosted, ahead: list) -> RDD:
    return state.map(lambda block: steps.moved_on(block, ahead))


def predict_trees(lines: DataFrame, bins: Bins, trees: list[Tree], settings: Settings | None = None) -> DataFrame:
    """The lines with ``prediction``: the mean of a forest, the weighted sum of boosted trees."""
    is_boosted = settings is not None and settings.rate is not None
    ready = [(settings.weight(t) if is_boosted else 1.0, tree, tree.values()) for t, tree in enumerate(trees)]
    n_numbers, share = len(bins.numbers), 1 if is_boosted else len(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = bins.of(batch)
            total = np.zeros(batch.num_rows)
            for weight, tree, values in ready:
                total += weight * values[tree.places(seen, n_numbers, tree.depth)]
            yield batch.append_column("prediction", pa.array(total / share))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInArrow(run, f"{schema}, prediction double")
