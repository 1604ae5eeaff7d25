"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles.  Tokens are put into one
global order, rare first, from a count sketch of fixed size.  If two sets
overlap enough, their prefixes of length ``n - need + l`` share at least ``l``
tokens; with lengths chosen per document the smaller ``l`` of a pair holds.
Each document takes the ``l`` whose postings and expected verifications cost
least by the sketch, so documents made of common passages get longer prefixes
and must share more tokens before they are verified.

Equal sets form one class, which is what is joined; copies are never expanded.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import store, temporary
from .components import components

U = np.uint64
#: Costs for choosing a prefix, see ``choose_match``.
PRIOR, POSTING, SHIP = 0.05, 10.0, 3.0
#: Postings a token partition holds on average, tokens a verification block holds, postings a task
#: collects before it sends them, classes a list of one token has undivided.
PART_POSTINGS, BLOCK_TOKENS, FLUSH, RUN = 1_000_000, 100_000, 300_000, 512
#: Documents of one token by the sketch, beyond which its postings are dealt into pairs of blocks before they are sent.
HOT_POSTINGS = 500_000
#: A bitmap of candidate documents is broadcast up to this many bits (16 MB); beyond, a join selects them.
BITMAP_BITS = 1 << 27


def _sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes by text, text numbers, set sizes, class hashes) of a block."""
    starts, ends, first = B.words(raw, offsets)
    h, of = B.sort_within(*B.shingles(B.word_hashes(raw, starts, ends), first, size))
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[keep], of[keep]
    n = np.bincount(of, minlength=len(offsets) - 1)
    sums = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        sums[full] = np.add.reduceat(B.mix(h + U(0x51ED270B)), np.concatenate([[0], np.cumsum(n[full])[:-1]]))
    return h, of, n, B.mix(sums + n.astype(np.uint64))


_SCANNED = ["id", "cls", "n", "h", "sketch"]


def _scan(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for i, j, raw, off in B.blocks(batch.column(1)):
                h, _, n, cls = _sets(raw, off, size)
                sketch += np.bincount((h >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(cls.view(np.int64), pa.int64(), mask=empty),
                        pa.array(n, pa.int64()),
                        batch.column(2).slice(i, j - i),
                        pa.nulls(j - i, pa.binary()),
                    ],
                    _SCANNED,
                )
        if sketch.any():
            yield _sketch_row(sketch)

    return run


def _sketch_row(sketch: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([zlib.compress(sketch.astype(np.int64).tobytes(), 1)], pa.binary())], _SCANNED)


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(4):
            one = np.frombuffer(zlib.decompress(blob.as_py()), np.int64)
            total = one.copy() if total is None else total + one
    if total is not None:
        yield _sketch_row(total)


def _sum_sketches(rows: DataFrame, bits: int) -> np.ndarray:
    """Add the tasks' sketches in a tree of fan-in 64; the driver sees at most 64 of fixed size."""
    n = rows.count()
    while n > 64:
        n = math.ceil(n / 64)
        rows = rows.repartition(n).mapInArrow(_add_sketches, rows.schema)
    total = np.zeros(1 << bits, np.int64)
    for row in rows.select("sketch").coalesce(1).mapInArrow(lambda it: (b.select(["sketch"]) for b in _add_sketches(_pad(it))), "sketch binary").collect():
        total += np.frombuffer(zlib.decompress(row[0]), np.int64)
    return total


def _pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, b.column(0)], _SCANNED)


def choose_match(kind: np.ndarray, start: np.ndarray, n: np.ndarray, need: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(l, prefix length) of each set, from its tokens' sketch classes in prefix order.

    A candidate that matches ``l`` tokens uses ``l`` postings, so candidates are
    estimated as the prefix's expected matches over ``l``: the excess frequency
    that the sketch shows, and ``PRIOR`` a token for what its noise hides.  Costs
    are in token operations, ``POSTING`` a posting and ``SHIP`` a token of a
    candidate's set.
    """
    mass = np.concatenate([[0.0], np.cumsum(excess[kind] + PRIOR)])
    best = np.full(len(n), np.inf)
    ell, length = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    k = 1
    while k <= max(1, int(need.max(initial=1))):
        p = np.minimum(n - need + k, n)
        cost = POSTING * p + SHIP * n * (mass[start + p] - mass[start]) / k
        better = (cost < best) & (k <= need) & (n > 0)
        best[better], ell[better], length[better] = cost[better], k, p[better]
        k *= 2
    return ell, length


def deal(token: np.ndarray, of: np.ndarray, cls: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, text number, side) of postings whose tokens have ``split`` blocks of classes.

    A token of several blocks becomes one token for each pair of blocks, so that no task
    has to hold all its classes.  A class goes to the pairs with its block i: as side 0
    where both blocks are i, else as side 1 or 2, and then meets the other side only.
    """
    hot = split > 1
    if not hot.any():
        return token, of, np.zeros(len(token), np.uint8)
    times = split[hot]
    mine = np.repeat((B.mix(cls[of[hot]]) % times.astype(U)).astype(np.int64), times)
    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    wide = np.repeat(times, times)
    cell = np.minimum(mine, other) * wide + np.maximum(mine, other)
    named = B.mix(np.repeat(token[hot], times) + U(0x9E3779B97F4A7C15) * (cell.astype(U) + U(1)))
    side = np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.uint8)
    text = np.concatenate([of[~hot], np.repeat(of[hot], times)])
    by = np.argsort(text, kind="stable")
    return np.concatenate([token[~hot], named])[by], text[by], np.concatenate([np.zeros(int((~hot).sum()), np.uint8), side])[by]


def _postings(size: int, percent: int, bits: int, order: np.ndarray, excess: np.ndarray, parts: int, hot: int):
    seen_by = 2.0 ** (np.arange(256) / 8) - 1
    split = np.where(seen_by > hot, 1 << np.ceil(np.log2(np.maximum(1, 2 * seen_by / hot))).astype(np.int64), 1)

    def flush(pile: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, side, cls, n, ell = (np.concatenate([x[k] for x in pile]) for k in (0, 5, 2, 3, 4))
        before = np.cumsum([0] + [len(x[2]) for x in pile])
        row = np.concatenate([x[1] + b for x, b in zip(pile, before)])
        part = (((token >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
        by = np.argsort(part.astype(np.uint16) if parts <= 65_536 else part, kind="stable")
        token, row, part, side = token[by], row[by], part[by], side[by]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        out: list[list] = [[] for _ in range(7)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            rows = row[lo:hi]
            runs = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True])
            mine = rows[runs[:-1]]
            for k, v in enumerate((int(part[lo]), token[lo:hi].tobytes(), np.diff(runs).astype(np.int32).tobytes(), cls[mine].tobytes(), n[mine].astype(np.int32).tobytes(), ell[mine].astype(np.int32).tobytes(), side[lo:hi].tobytes())):
                out[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32())] + [pa.array(x, pa.binary()) for x in out[1:]], ["part", "token", "cnt", "cls", "n", "ell", "side"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # one entry a class of this task's split
        pile, held = [], 0
        for batch in batches:
            for _, _, raw, off in B.blocks(batch.column(0)):
                h, of, n, cls = _sets(raw, off, size)
                fresh = np.zeros(len(n), bool)
                for k in np.flatnonzero(n):
                    c = int(cls[k])
                    if c not in seen:
                        seen.add(c)
                        fresh[k] = True
                keep = fresh[of]
                h, of = h[keep], of[keep]
                if not len(h):
                    continue
                kind = order[(h >> U(64 - bits)).astype(np.int64)]
                by = np.argsort((kind.astype(np.uint64) << U(56)) | (h >> U(8)), kind="stable")
                by = by[np.argsort(of[by].astype(np.uint16), kind="stable")]
                h, of, kind = h[by], of[by], kind[by]
                n = np.where(fresh, n, 0)
                start = np.concatenate([[0], np.cumsum(n)])[:-1]
                ell, length = choose_match(kind, start, n, (percent * n + 99) // 100, excess)
                inside = np.arange(len(h)) - start[of] < length[of]
                token, text, side = deal(h[inside], of[inside], cls, split[kind[inside]])
                pile.append((token, text, cls, n, ell, side))
                held += len(token)
                if held > FLUSH:
                    yield flush(pile)
                    pile, held = [], 0
        if pile:
            yield flush(pile)

    return run


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``values`` up to each of ``ends`` as binary values."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _runs(longest: int):
    """Lists of the classes that share a token, equal lists as one with its number of tokens.

    A list goes by its smallest class, so the lists of a group of similar sets meet
    in one place whatever partitions their tokens were in.  A list longer than
    ``longest`` is dealt into blocks by class; pairs of blocks go their own ways, and
    ``cut`` says where the second block begins.  A list of two sides (see ``deal``) is
    such a pair from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            for k, kind in enumerate((np.uint64, np.int32, np.int64, np.int32, np.int32, np.uint8)):
                got[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k + 1)]
        if not got[0]:
            return
        token, cnt, cls, n, ell, side = (np.concatenate(x) for x in got)
        del got
        names, at, index = np.unique(cls, return_index=True, return_inverse=True)
        n, ell = n[at], ell[at]
        who = np.repeat(index.astype(np.int32), cnt)
        by = np.argsort(token)
        token, who, side = token[by], who[by], side[by]
        same = token[1:] == token[:-1]
        several = np.r_[same, False] | np.r_[False, same]
        token, who, side = token[several], who[several], side[several]
        by = np.lexsort((who, n[who], side, token))
        token, who, side = token[by], who[by], side[by]
        if len(token):
            keep = np.r_[True, (token[1:] != token[:-1]) | (who[1:] != who[:-1])]
            token, who, side = token[keep], who[keep], side[keep]
        cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)
        size = np.diff(cut)
        cut = cut[:-1]
        ones = np.add.reduceat(side == 1, cut) if len(cut) else size
        good = (size > 1) & ((side[cut] == 0) | ((ones > 0) & (ones < size)))
        cut, size, ones = cut[good], size[good], ones[good]
        if not len(cut):
            return
        inside = np.repeat(cut - np.cumsum(size) + size, size) + np.arange(size.sum())
        who, side, first = who[inside], side[inside], np.cumsum(size) - size
        print_of = np.add.reduceat(B.mix(names[who].view(np.uint64) + _SIDES[side]), first)
        _, at, times = np.unique(print_of, return_index=True, return_counts=True)
        first, size, ones = first[at], size[at], ones[at]
        short = np.flatnonzero(size <= longest)
        for lo in range(0, len(short), 20_000):
            some = short[lo : lo + 20_000]
            k, f = size[some], first[some]
            flat = who[np.repeat(f - np.cumsum(k) + k, k) + np.arange(k.sum())]
            ends = np.cumsum(k)
            low = np.minimum.reduceat(names[flat], ends - k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(low), pa.array(times[some]), pa.array(ones[some].astype(np.int32)), _binary(names[flat], ends), _binary(n[flat], ends), _binary(ell[flat], ends)], _RUN_NAMES
            )
        for r in np.flatnonzero(size > longest):
            own = who[first[r] : first[r] + size[r]]
            blocks = 1 << int(np.ceil(np.log2(2 * size[r] / longest)))
            place = (B.mix(names[own].view(np.uint64) + U(1)) % U(blocks)).astype(np.int64)
            low, two = int(names[own].min()), side[first[r] : first[r] + size[r]] == 2
            if ones[r]:  # blocks of one side with blocks of the other
                parts = [own[(place == i) & ~two] for i in range(blocks)] + [own[(place == i) & two] for i in range(blocks)]
                pairs = [(i, j) for i in range(blocks) for j in range(blocks, 2 * blocks)]
            else:
                parts = [own[place == i] for i in range(blocks)]
                pairs = [(i, j) for i in range(blocks) for j in range(i, blocks)]
            for i, j in pairs:
                if len(parts[i]) and len(parts[j]):
                    mine = parts[i] if i == j else np.concatenate([parts[i], parts[j]])
                    key = int(B.mix(np.array([low], np.int64).view(np.uint64) + U(2 * i * blocks + j)).view(np.int64)[0])
                    ends = np.array([len(mine)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([int(times[r])]), pa.array([0 if i == j else len(parts[i])], pa.int32()), _binary(names[mine], ends), _binary(n[mine], ends), _binary(ell[mine], ends)], _RUN_NAMES
                    )

    return run


#: Sets the prints of lists with sides apart.
_SIDES = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
_RUN_NAMES = ["key", "times", "cut", "cls", "n", "ell"]


def _pairs(percent: int):
    """Pairs of classes of compatible sizes with the number of tokens they share in the lists of a batch."""

    def emit(code: np.ndarray, count: np.ndarray, names: np.ndarray, n: np.ndarray, ell: np.ndarray) -> pa.RecordBatch:
        a, b = code // len(names), code % len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(names[a]), pa.array(names[b]), pa.array(count.astype(np.int64)), pa.array(np.minimum(ell[a], ell[b]).astype(np.int64)), pa.array(n[a].astype(np.int64)), pa.array(n[b].astype(np.int64))],
            ["a", "b", "shared", "least", "na", "nb"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, n, ell = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)]) for k, kind in ((3, np.int64), (4, np.int32), (5, np.int32)))
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column(3)])
            times, cut = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            names, at, who = np.unique(cls, return_index=True, return_inverse=True)
            n, ell = n[at].astype(np.int64), ell[at]
            row = np.repeat(np.arange(len(size)), size)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            # members partner with the larger ones of their list, or of the list's other block
            second = inner >= cut[row]
            group = np.where(cut[row] > 0, 2 * row + second, 2 * row)
            order = np.lexsort((n[who], group))
            row, group, member = row[order], group[order], who[order]
            place = (group << 32) + n[member]
            other = np.where(cut[row] > 0, group ^ 1, group)
            lower = np.where(cut[row] > 0, np.searchsorted(place, (other << 32) + n[member] + (group & 1)), np.arange(len(row)) + 1)
            upper = np.searchsorted(place, (other << 32) + 100 * n[member] // percent, "right")
            m = np.maximum(upper - lower, 0)
            total = np.cumsum(m)
            codes, counts, held, i = [], [], 0, 0
            while i < len(row):
                base = total[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(total, base + 1_000_000, "right")))
                mm = m[i:j]
                left = np.repeat(np.arange(i, j), mm)
                right = np.repeat(lower[i:j] - np.cumsum(mm) + mm, mm) + np.arange(len(left))
                x, y = member[left], member[right]
                code, back = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_inverse=True)
                codes.append(code)
                counts.append(np.bincount(back, times[row[left]], minlength=len(code)))
                held += len(code)
                i = j
                if held > 2_500_000 or i == len(row):
                    code, back = np.unique(np.concatenate(codes), return_inverse=True)
                    count = np.bincount(back, np.concatenate(counts), minlength=len(code))
                    for lo in range(0, len(code), 200_000):
                        yield emit(code[lo : lo + 200_000], count[lo : lo + 200_000], names, n, ell)
                    codes, counts, held = [], [], 0

    return run


def _full_sets(size: int, bitmap: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                p = batch.column(1).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            for _, _, raw, off in B.blocks(batch.column(0)):
                h, _, n, cls = _sets(raw, off, size)
                ends = np.cumsum(n)
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(cls[full].view(np.int64)), pa.array([h[ends[k] - n[k] : ends[k]].tobytes() for k in full], pa.binary())], ["cls", "blob"])

    return run


class Block:
    """The sets at home in one block, as one sorted token column; others are counted against it one at a time."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.row = {c: i for i, c in enumerate(sets)}
        self.size = np.array([len(x) for x in sets.values()], np.int64)
        tokens = np.concatenate(list(sets.values())) if sets else np.zeros(0, np.uint64)
        by = np.argsort(tokens)
        self.tokens, self.owner = tokens[by], np.repeat(np.arange(len(sets)), self.size)[by]

    def overlaps(self, one: np.ndarray) -> np.ndarray:
        lo, hi = self.tokens.searchsorted(one, "left"), self.tokens.searchsorted(one, "right")
        m = hi - lo
        at = np.repeat(lo - np.cumsum(m) + m, m) + np.arange(m.sum())
        return np.bincount(self.owner[at], minlength=len(self.size))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        last, sets, block = None, {}, None
        for batch in batches:
            home, cls, ends = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            blob = batch.column(3)
            for k in range(batch.num_rows):
                if home[k] != last:
                    last, sets, block = home[k], {}, None
                one = np.frombuffer(blob[k].as_buffer(), np.uint64)
                with_ = ends[k].as_py()
                if with_ is None:
                    sets[cls[k]] = one
                    continue
                if block is None:
                    block = Block(sets)
                row = np.array([block.row[c] for c in with_])
                inter = block.overlaps(one)[row]
                ok = 100 * inter >= percent * (block.size[row] + len(one) - inter)
                out += [(c, cls[k]) for c, fine in zip(with_, ok.tolist()) if fine]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])
                out = []

    return run


def _candidate_bitmap(ids: DataFrame, n: int) -> tuple[np.ndarray | None, int]:
    bits = max(1 << 15, 1 << math.ceil(math.log2(16 * max(1, n))))
    if bits > BITMAP_BITS:
        return None, bits
    place = F.xxhash64("id").bitwiseAND(F.lit(bits - 1))
    rows = (
        ids.select(place.alias("p"))
        .groupBy((F.col("p") / 32768).cast("int").alias("k"))
        .agg(F.bitmap_construct_agg((F.col("p") % 32768).cast("int")).alias("bits"))
        .collect()
    )
    out = np.zeros(bits >> 3, np.uint8)
    for k, blob in rows:
        out[k * 4096 : k * 4096 + len(blob)] = np.frombuffer(blob, np.uint8)
    return out, bits


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 70, sketch_bits: int = 20, longest_list: int = RUN, hot_postings: int = HOT_POSTINGS
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, class_id, n_similar, component_id,
    component_class, text_hash.

    Two rows link when 100 * intersection >= percent * union of their sets of
    distinct ``size``-word shingles (A-Z lower-cased; words are runs without ASCII
    white space; a text of fewer words is one shingle).  ``class_id`` names rows of
    equal sets, ``n_similar`` counts the other rows linked, ``component_id`` is the
    smallest id reachable through links, ``component_class`` names the component also
    where no id does, and ``text_hash`` (xxhash64) tells rows of equal ids apart.

    A null, empty or white text has no set, class or link and is its own
    component.  A null id is carried along and counts as a row; it never is the
    smallest id unless all in its component are null.  Rows with equal ids are
    separate documents.  Other columns are not read.
    """
    with temporary() as keep:
        rows, facts = _groups(docs, id_col, text_col, size, percent, sketch_bits, longest_list, hot_postings)
        facts = keep(store(facts))
        keep(rows)
    rows = rows.filter("n is not null").select("id", "cls", "n", "h")
    return rows.join(facts, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"),
        F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("root", "cls").alias("component_class"), F.col("h").alias("text_hash"),
    )


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, sketch_bits: int, longest_list: int, hot_postings: int) -> tuple[DataFrame, DataFrame]:
    """The stored scan of all rows, and (cls, n_similar, component_id, root) of the classes that link or have copies."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hashed = base.withColumn("h", F.xxhash64("text"))
    scan = store(hashed.mapInArrow(B.lean(_scan(size, sketch_bits)), "id long, cls long, n long, h long, sketch binary"))
    rows = scan.filter("n is not null").select("id", "cls", "n", "h")
    classes = store(rows.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.max("n").alias("n")))
    sketch = _sum_sketches(scan.filter("sketch is not null"), sketch_bits)
    noise = sketch.mean()
    order = np.minimum(255, np.rint(8 * np.log2(sketch + 1.0))).astype(np.uint8)
    excess = np.maximum(0.0, 2.0 ** (np.arange(256) / 8) - 1 - noise - 3 * noise**0.5)
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(tokens * (100 - percent) / 100 / PART_POSTINGS))
    postings = base.select("text").mapInArrow(
        B.lean(_postings(size, percent, sketch_bits, order, excess, parts, hot_postings)), "part int, token binary, cnt binary, cls binary, n binary, ell binary, side binary"
    )
    runs = postings.repartitionById(parts, F.col("part")).mapInArrow(B.lean(_runs(longest_list)), "key long, times long, cut int, cls binary, n binary, ell binary")
    pairs = runs.repartition("key").sortWithinPartitions("key").mapInArrow(B.lean(_pairs(percent)), "a long, b long, shared long, least long, na long, nb long")
    found = store(pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"), F.max("na").alias("na"), F.max("nb").alias("nb")).filter("shared >= least").select("a", "b", "na", "nb"))

    ends = found.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("na").alias("n")).union(found.select("b", "a", "nb"))
    label = ends.groupBy("v").agg(F.min("w").alias("w"), F.max("n").alias("n")).select("v", F.least("v", "w").alias("label"), "n")
    spread = label.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("k"))
    place = store(label.join(spread, "label").select("v", F.xxhash64("label", F.pmod(F.xxhash64("v"), "k")).alias("g")))
    at_home = F.col("ga") <= F.col("gb")
    visits = (
        found.join(place.select(F.col("v").alias("a"), F.col("g").alias("ga")), "a")
        .join(place.select(F.col("v").alias("b"), F.col("g").alias("gb")), "b")
        .select(F.least("ga", "gb").alias("home"), F.when(at_home, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(at_home, F.col("b")).otherwise(F.col("a")).alias("cls"))
    )
    visits = store(visits.groupBy("home", "cls").agg(F.collect_list("x").alias("ends")))
    members = visits.select("home", F.explode("ends").alias("cls")).distinct().select("home", "cls", F.lit(None).cast("array<long>").alias("ends")).union(visits)
    chosen = place.select(F.col("v").alias("cls")).join(classes.select("cls", F.col("low").alias("id")), "cls")
    bitmap, bits = _candidate_bitmap(chosen, place.count())
    wanted = base.select("text", F.xxhash64("id").bitwiseAND(F.lit(bits - 1)).alias("p"))
    if bitmap is None:
        wanted = base.join(chosen.select("id").distinct(), base["id"].eqNullSafe(chosen["id"]), "left_semi").select("text", F.lit(0).cast("long").alias("p"))
    sets = wanted.mapInArrow(B.lean(_full_sets(size, bitmap)), "cls long, blob binary")
    work = members.join(sets, "cls").select("home", "cls", "ends", "blob")
    links = store(work.repartition("home").sortWithinPartitions("home", F.col("ends").isNotNull()).mapInArrow(B.lean(_verify(percent)), "a long, b long").distinct())

    both = links.union(links.select("b", "a"))
    near = both.join(classes.select(F.col("cls").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("near"))
    comp = components(links)
    low = comp.join(classes.select(F.col("cls").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("component"))
    facts = (
        classes.join(near.withColumnRenamed("a", "cls"), "cls", "left")
        .join(comp.join(low, "root").select(F.col("node").alias("cls"), "root", "component"), "cls", "left")
        .filter("copies > 1 or near is not null")
        .select("cls", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_similar"), F.coalesce("component", "low").alias("component_id"), F.coalesce("root", "cls").alias("root"))
    )
    return scan, facts
