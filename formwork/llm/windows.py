"""Passages that occur twice: windows of words or bytes found by minimiser buckets.

Both operators share the way to their buckets.  A window is ``width`` consecutive symbols of one
document.  Its minimiser is the least of the ``part``-symbol pieces in it, and consecutive windows
with the minimiser at the same place travel as one packed string (a super-k-mer) to the bucket of
the minimiser.  Equal windows have equal minimisers, so each bucket can be judged alone.

* The order of pieces puts frequent ones last: a sketch of fixed size counts all pieces of all
  documents, and pieces in cells with far more than their share come after all others.  A window
  that reaches beyond a common passage thus goes where its rarer part sends it, and no bucket
  gathers the surroundings of a common passage.  The sketch has more cells where there is more
  input, so that what counts as frequent doesn't rise with it, up to ``MOST_CELLS``, which bounds
  what a task, its closure and the driver hold.
* The strings that tasks would send are counted by minimiser.  Where there are more than
  ``per_group`` (at very large inputs, than a 2**20th of all strings), the windows travel one by one and by a longer key, the hash of all their symbols,
  so that a group of these holds copies of one window only.  There are up to ``MOST_HOT`` of these
  minimisers, so that a task's list of them is bounded, too; what these bounds leave is a larger group, with the same result.
* Each task folds equal strings before the shuffle.  Strings it saw twice are settled there and
  travel once, without their places; the others travel with theirs.

Words are runs without ASCII white space.
"""

from __future__ import annotations

import dataclasses
import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import BLANK, CELLS, Rolling, Texts, arrow_column, keyed, sliding_min, text_chunks, type_of, written

#: Bytes of texts that are hashed at a time: their arrays stay in a core's cache.
_AT_ONCE = 128 << 10
_PACKED = "bucket long, pack binary, key_a long, key_b long, spans binary"
_SPANS = "key_a long, key_b long, begin int, end int"


@dataclass(frozen=True)
class Plan:
    """width: symbols of a window; part: of a minimiser; words: symbols are words, else bytes.

    per_bucket: symbols of input for each bucket, about; held: bytes of packed strings that a task
    folds before it sends them.  per_group: strings of one minimiser beyond which its windows
    travel one by one.  longest: bytes beyond which a text is divided, so that a task's arrays don't
    grow with a text."""

    width: int
    part: int
    words: bool
    per_bucket: int
    held: int = 48 << 20
    per_group: int = 20_000
    longest: int = 4 << 20


class _Symbols:
    """The symbols of some texts: ``flat`` bytes, where each symbol starts and ends there, and
    which symbols (``low`` to ``high``) each text has."""

    def __init__(self, texts: list[bytes], words: bool):
        held = Texts(texts)
        if words:
            held.words()
            self.flat, self.starts, self.ends = held.spaced()
            self.low, self.high = held.first[:-1], held.first[1:]
        else:
            self.flat = held.data.tobytes()
            self.starts = np.arange(len(held.data))
            self.ends = self.starts + 1
            self.low, self.high = held.begins, held.begins + held.lengths
        self.rolling = Rolling(np.frombuffer(self.flat, np.uint8))

    def inside(self, width: int) -> np.ndarray:
        """For each place at which ``width`` symbols follow: whether one text has them all."""
        n = max(0, len(self.starts) - width + 1)
        marks = np.zeros(len(self.starts) + 1, np.int32)
        long = self.high - self.low >= width
        np.add.at(marks, self.low[long], 1)
        np.add.at(marks, self.high[long] - width + 1, -1)
        return np.cumsum(marks)[:n] > 0

    def hashes(self, width: int) -> np.ndarray:
        n = len(self.starts) - width + 1
        return self.rolling.of(self.starts[:n], self.ends[width - 1 :]) if n > 0 else np.zeros(0, np.uint64)


#: Cells of the sketch at most: 64 MiB of counts in a task, 2 MiB of bits in a closure and on the driver.
MOST_CELLS = 1 << 24
#: Minimisers whose windows travel one by one at most: 8 MiB in a closure and on the driver.
MOST_HOT = 1 << 20


def sketch_cells(symbols: int) -> int:
    """Cells of the sketch: as many more as the input has more than 2**29 symbols, in powers of two,
    up to ``MOST_CELLS``.

    Up to 2**37 symbols the mean cell has 2**13 pieces at most, so that frequent pieces begin at
    2**16 or below; beyond, they begin at 8 times the mean cell."""
    return min(MOST_CELLS, CELLS << max(0, (symbols - 1) >> 29).bit_length())


def hot_from(pieces: int, plan: Plan) -> int:
    """Strings of a minimiser beyond which its windows travel one by one, for so many pieces in all:
    ``per_group``, or a 2**20th of the strings that random texts would give, if that is more."""
    strings = 2 * pieces // (plan.width - plan.part + 2)
    return max(plan.per_group, strings // MOST_HOT)


def common_pieces(texts: DataFrame, plan: Plan, cells: int) -> tuple[np.ndarray, int]:
    """Which cells of the sketch have far more than their share of all documents' pieces (packed
    bits), and the number of pieces.

    Cells are added up in blocks by the executors."""
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for _, _, chunk, _ in _divided(batches, dataclasses.replace(plan, width=plan.part)):
            s = _Symbols(chunk, plan.words)
            np.add.at(total, (s.hashes(plan.part)[s.inside(plan.part)] >> shift).astype(np.int64), np.uint32(1))
        blocks = total.reshape(-1, 1 << 14)
        packed = [zstandard.compress(x.tobytes(), 1) for x in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << 14, np.int64)
        for raw in rows.column("counts").to_pylist():
            total += np.frombuffer(zstandard.decompress(raw), np.uint32)
        return pa.table({"block": rows.column("block").slice(0, 1), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    sums = written(texts.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary"))

    def size(batches) -> Iterator[pa.RecordBatch]:
        n = sum(int(np.frombuffer(zstandard.decompress(raw), np.int64).sum()) for x in batches for raw in x.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    pieces = int(sums.select("counts").mapInArrow(size, "n long").agg(F.sum("n")).first()[0] or 0)
    most = max(64, 8 * pieces // cells)

    def over(batches) -> Iterator[pa.RecordBatch]:
        for x in batches:
            bits = [np.packbits(np.frombuffer(zstandard.decompress(raw), np.int64) > most).tobytes() for raw in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(bits, pa.binary())], ["block", "bits"])

    found = np.zeros(cells // 8, np.uint8)
    for row in sums.mapInArrow(over, "block int, bits binary").collect():
        found[row.block << 11 : (row.block + 1) << 11] = np.frombuffer(row.bits, np.uint8)
    return found, pieces


def hot_minimisers(texts: DataFrame, plan: Plan, bits: np.ndarray, pieces: int) -> np.ndarray:
    """Sorted minimisers of which tasks would send more than ``hot_from`` strings; of more than
    ``MOST_HOT`` the most frequent.

    A task counts the distinct strings of each; it leaves out counts below four, so that what is
    missed is three strings a task at most."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        common, minimisers, strings, size = np.unpackbits(bits).astype(bool), [], [], 0

        def counts() -> pa.RecordBatch:
            none = [np.zeros(0, np.uint64)]
            first = np.unique(np.concatenate(strings or none), return_index=True)[1]
            which, often = np.unique(np.concatenate(minimisers or none)[first], return_counts=True)
            some = often > 3
            return pa.RecordBatch.from_arrays([pa.array(which[some].view(np.int64)), pa.array(often[some])], ["minimiser", "n"])

        for _, _, chunk, _ in _divided(batches, plan):
            s = _Symbols(chunk, plan.words)
            first, last, minimiser, _ = _runs(s, plan, common, np.zeros(0, np.uint64))
            if len(first):
                minimisers.append(minimiser)
                strings.append(s.rolling.of(s.starts[first], s.ends[last + (plan.width - 2)]))
                size += len(first)
            if size > 4_000_000:
                yield counts()
                minimisers, strings, size = [], [], 0
        yield counts()

    rows = texts.select("text").mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")).filter(F.col("n") > hot_from(pieces, plan))
    most = rows.orderBy(F.desc("n"), "minimiser").limit(MOST_HOT).select("minimiser").toArrow()
    return np.sort(most.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _runs(s: _Symbols, plan: Plan, common: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first window, the end of the windows, the minimiser's hash and its place
    behind the first window's beginning.  Windows of ``hot`` minimisers stand alone, by their own hash."""
    ok = s.inside(plan.width)
    if not ok.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = s.hashes(plan.part)
    cell = (h >> np.uint64(64 - (len(common).bit_length() - 1))).astype(np.int64)
    order = (h & np.uint64(0x7FFFFFFF)) | (common[cell].astype(np.uint64) << np.uint64(31))
    least = sliding_min((order << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), plan.width - plan.part + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at[~ok] = -1
    edge = np.flatnonzero(np.diff(at)) + 1
    begins, ends = np.append(0, edge), np.append(edge, len(at))
    real = at[begins] >= 0
    begins, ends = begins[real], ends[real]
    groups = h[at[begins]]
    alone = np.isin(groups, hot)
    if alone.any():
        times = np.where(alone, ends - begins, 1)
        alone, groups = np.repeat(alone, times), np.repeat(groups, times)
        step = np.arange(len(groups)) - np.repeat(np.cumsum(times) - times, times)
        begins, ends = np.repeat(begins, times) + step, np.repeat(ends, times)
        ends[alone] = begins[alone] + 1
        groups[alone] = s.hashes(plan.width)[begins[alone]]
    return begins, ends, groups, at[begins] - begins


def _divided(batches, plan: Plan) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes], np.ndarray]]:
    """Chunks of texts (``text_chunks``): rows, and for each text or piece of a long one its row, its bytes and
    the symbol at which it begins.  Pieces overlap by one symbol less than a window, so each window is in one."""
    for part, chunk in text_chunks(batches, _AT_ONCE):
        if max(map(len, chunk)) <= plan.longest:
            yield part, np.arange(len(chunk)), chunk, np.zeros(len(chunk), np.int64)
            continue
        for i, text in enumerate(chunk):
            for begin, piece in _overlapping(text, plan) if len(text) > plan.longest else [(0, text)]:
                yield part, np.array([i]), [piece], np.array([begin])


def _overlapping(text: bytes, plan: Plan) -> Iterator[tuple[int, bytes]]:
    """(first symbol, bytes) of the pieces of a long text."""
    if not plan.words:
        for a in range(0, max(1, len(text) - plan.width + 1), plan.longest):
            yield a, text[a : a + plan.longest + plan.width - 1]
        return
    edges = np.flatnonzero(np.diff(BLANK[np.frombuffer(text, np.uint8)], prepend=True, append=True))
    starts, ends = edges[0::2], edges[1::2]
    step = max(1, plan.longest * len(starts) // len(text))
    for k in range(0, max(0, len(starts) - plan.width + 1), step):
        yield k, text[starts[k] : ends[min(len(ends), k + step + plan.width - 1) - 1]]


class _Folded:
    """Super-k-mers of a task, equal ones folded, until they are sent."""

    def __init__(self, plan: Plan, buckets: int):
        self.plan, self.buckets = plan, buckets
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.which: list[np.ndarray] = []
        self.places: list[tuple[np.ndarray, ...]] = []
        self.groups: list[int] = []
        self.offsets: list[int] = []
        self.size = 0

    def add(self, s: _Symbols, ids: np.ndarray, keys: np.ndarray, begins: np.ndarray, common: np.ndarray, hot: np.ndarray) -> None:
        """The super-k-mers of texts, or of pieces that begin at the symbols ``begins`` of theirs."""
        first, last, minimiser, offset = _runs(s, self.plan, common, hot)
        if not len(first):
            return
        width, flat, number, groups, offsets = self.plan.width, s.flat, self.number, self.groups, self.offsets
        which = np.empty(len(first), np.int64)
        for r, (a, b, m, o) in enumerate(zip(s.starts[first].tolist(), s.ends[last + (width - 2)].tolist(), minimiser.tolist(), offset.tolist())):
            packed = flat[a:b]
            n = number.setdefault(packed, len(number))
            if n == len(groups):
                groups.append(m)
                offsets.append(o)
                self.size += b - a + 100
            which[r] = n
        text = np.searchsorted(s.low, first, side="right") - 1
        place = first - s.low[text] + begins[text]
        self.which.append(which)
        self.places.append((ids[text], keys[text], place.astype(np.int32), (place + (last - first) + width - 1).astype(np.int32)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is sent: packed strings by bucket, and the settled spans, spread evenly."""
        if not self.number:
            return
        which = np.concatenate(self.which)
        ids, keys, begin, end = (np.concatenate(x) for x in zip(*self.places))
        often = np.bincount(which, minlength=len(self.number))
        twice = often[which] > 1
        out: list[tuple] = []
        settled = list(_joined(ids[twice], keys[twice], begin[twice], end[twice]))
        out += [(-1 - (i ^ k) % self.buckets, None, i, k, spans) for i, k, spans in settled]
        owner = np.full(len(self.number), -1)
        owner[which[~twice]] = np.flatnonzero(~twice)
        groups, offsets = np.array(self.groups, np.uint64), np.array(self.offsets, np.int32)
        bucket = ((groups >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        strings = list(self.number)
        lengths = np.fromiter(map(len, strings), np.int32, len(strings))
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            some = order[a:b]
            own = owner[some]
            head = [lengths[some], groups[some].astype(np.uint32), offsets[some], np.where(own < 0, -1, begin[own])]
            own = own[own >= 0]
            head += [ids[own], keys[own]]
            body = b"".join([*(x.astype(t).tobytes() for x, t in zip(head, ("<i4", "<u4", "<i4", "<i4", "<i8", "<i8"))), *(strings[i] for i in some.tolist())])
            out.append((int(bucket[some[0]]), struct.pack("<ii", len(some), len(own)) + self.squeeze.compress(body), None, None, None))
        self.clear()
        for i in range(0, len(out), 500):
            columns = list(zip(*out[i : i + 500]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "pack", "key_a", "key_b", "spans"])


def _joined(ids: np.ndarray, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """For each text the union of its spans, as int32 pairs."""
    if not len(ids):
        return
    order = np.lexsort((begin, keys, ids))
    ids, keys, begin, end = ids[order], keys[order], begin[order], end[order]
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(keys) != 0))
    cuts = np.flatnonzero(new)
    for a, b in zip(cuts, [*cuts[1:], len(ids)]):
        yield int(ids[a]), int(keys[a]), union(np.stack([begin[a:b], end[a:b]], axis=1)).astype("<i4").tobytes()


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by spans (rows begin, end)."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > reach[:-1])
    starts = np.flatnonzero(first)
    return np.stack([spans[starts, 0], reach[np.append(starts[1:], len(spans)) - 1]], axis=1)


def _unpacked(packs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """The distinct strings of a bucket, whether each occurs twice, its group and its minimiser's
    offset, and the places (string, id, key, begin)."""
    number: dict[bytes, int] = {}
    groups: list[int] = []
    offsets: list[int] = []
    twice: list[bool] = []
    places: list[tuple[np.ndarray, ...]] = []
    for pack in packs:
        n, own = struct.unpack_from("<ii", pack)
        raw = zstandard.ZstdDecompressor().decompress(pack[8:])
        at = 0

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x

        lengths, group, offset, begin = take(n, "<i4"), take(n, "<u4"), take(n, "<i4"), take(n, "<i4")
        ids, keys = take(own, "<i8"), take(own, "<i8")
        which = np.empty(n, np.int64)
        for i, (size, g, o, b) in enumerate(zip(lengths.tolist(), group.tolist(), offset.tolist(), begin.tolist())):
            k = number.setdefault(raw[at : at + size], len(number))
            at += size
            if k == len(groups):
                groups.append(g)
                offsets.append(o)
                twice.append(b < 0)
            else:
                twice[k] = True
            which[i] = k
        placed = begin >= 0
        places.append((which[placed], ids, keys, begin[placed]))
    return list(number), np.array(twice, bool), np.array(groups, np.uint32), np.array(offsets, np.int64), tuple(np.concatenate(x) for x in zip(*places))


Judge = Callable[[list[bytes], np.ndarray, np.ndarray], dict[int, np.ndarray]]


def repeated_spans(texts: DataFrame, plan: Plan, judge: Judge) -> DataFrame:
    """Spans of symbols covered by windows that occur twice: ``key_a, key_b, begin, end``.

    ``judge(strings, groups, offsets)`` gets a bucket's distinct strings, each one's minimiser and
    where it stands, and returns, for strings that have them, a mask of the windows that another string shares."""
    symbols = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, total = common_pieces(texts, plan, sketch_cells(symbols))
    hot = hot_minimisers(texts, plan, bits, total)
    buckets = max(1, -(-total // plan.per_bucket))
    width, words = plan.width, plan.words

    def pack(batches) -> Iterator[pa.RecordBatch]:
        folded, common = _Folded(plan, buckets), np.unpackbits(bits).astype(bool)
        for part, row, chunk, begins in _divided(batches, plan):
            folded.add(_Symbols(chunk, words), arrow_column(part, "key_a")[row], arrow_column(part, "key_b")[row], begins, common, hot)
            if folded.size > plan.held:
                yield from folded.rows()
        yield from folded.rows()

    def open_bucket(rows: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if rows.column("bucket")[0].as_py() < 0:
            for i, k, spans in zip(*(rows.column(c).to_pylist() for c in ("key_a", "key_b", "spans"))):
                pairs = np.frombuffer(spans, "<i4").reshape(-1, 2)
                out.append(np.column_stack([np.full(len(pairs), i), np.full(len(pairs), k), pairs]))
        else:
            strings, twice, groups, offsets, (which, ids, keys, begin) = _unpacked(rows.column("pack").to_pylist())
            masks = judge(strings, groups, offsets)
            symbols = np.fromiter((x.count(b" ") + 1 if words else len(x) for x in strings), np.int64, len(strings))
            whole = twice[which]
            out.append(np.column_stack([ids[whole], keys[whole], begin[whole], begin[whole] + symbols[which[whole]]]))
            for j in np.flatnonzero(~whole).tolist():
                mask = masks.get(int(which[j]))
                if mask is not None:
                    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    spans = union(edges + np.array([0, width - 1])) + begin[j]
                    out.append(np.column_stack([np.full(len(spans), ids[j]), np.full(len(spans), keys[j]), spans]))
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pa.table([pa.array(found[:, i], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key_a", "key_b", "begin", "end"])

    sent = texts.select("key_a", "key_b", "text").mapInArrow(pack, _PACKED)
    return sent.groupBy("bucket").applyInArrow(open_bucket, _SPANS)


# -------------------------------------------------------------------------------- judges


def sorted_windows(width: int) -> Judge:
    """Counts a bucket's windows of words by sorting them.

    Windows are sorted by a hash; neighbours of equal hash are compared word for word, so that the
    counts are exact."""

    def judge(strings: list[bytes], groups: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        hashes, owners, places, lows, highs = [], [], [], [], []
        at = 0
        while at < len(strings):
            some, size = at, 0
            while at < len(strings) and size < 2 << 20:
                size += len(strings[at])
                at += 1
            s = _Symbols(strings[some:at], True)
            ok = np.flatnonzero(s.inside(width))
            owner = np.searchsorted(s.low, ok, side="right") - 1
            base = s.starts[s.low[owner]]
            hashes.append(s.hashes(width)[ok])
            owners.append((owner + some).astype(np.int32))
            places.append((ok - s.low[owner]).astype(np.int32))
            lows.append((s.starts[ok] - base).astype(np.int32))
            highs.append((s.ends[ok + width - 1] - base).astype(np.int32))
        if not hashes:
            return {}
        h, owner, place, low, high = (np.concatenate(x) for x in (hashes, owners, places, lows, highs))
        order = np.argsort(h)
        same = np.diff(h[order]) == 0
        if not same.any():
            return {}
        near = np.append(same, False) | np.append(False, same)
        order = order[near]
        window = [strings[o][a:b] for o, a, b in zip(owner[order].tolist(), low[order].tolist(), high[order].tolist())]
        values = h[order].tolist()
        shared = np.zeros(len(order), bool)
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and values[j] == values[i]:
                j += 1
            if all(x == window[i] for x in window[i + 1 : j]):
                shared[i:j] = True
            else:
                seen: dict[bytes, list[int]] = {}
                for t in range(i, j):
                    seen.setdefault(window[t], []).append(t)
                for t in seen.values():
                    shared[t] = len(t) > 1
            i = j
        order = order[shared]
        counts = np.bincount(owner, minlength=len(strings))
        masks: dict[int, np.ndarray] = {}
        for o, p in zip(owner[order].tolist(), place[order].tolist()):
            if o not in masks:
                masks[o] = np.zeros(counts[o], bool)
            masks[o][p] = True
        return masks

    return judge


class _Sequence:
    """The rows of a transform, a symbol and a common prefix each, as a file that is read and written
    from its beginning to its end, some rows at a time.

    A row is one number, the symbol above ``bits`` bits of common prefix."""

    def __init__(self, folder: str, symbols: int, width: int, piece: int):
        self.bits = 8 if width < 256 else 16
        self.kind = np.dtype(np.uint16 if self.bits == 8 and symbols <= 256 else np.uint32)
        self.piece, self.rows = piece, 0
        self.file, self.other = (open(f"{folder}/rows-{k}", "w+b", buffering=0) for k in "ab")

    def row(self, symbol: np.ndarray, common: np.ndarray) -> np.ndarray:
        return (symbol.astype(self.kind) << self.bits) | common.astype(self.kind)

    def symbols(self, rows: np.ndarray) -> np.ndarray:
        return rows >> self.bits

    def common(self, rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.uint8 if self.bits == 8 else np.uint16)  # the lower bits

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) for all rows."""
        self.file.seek(0)
        for at in range(0, self.rows, self.piece):
            yield at, np.fromfile(self.file, self.kind, min(self.piece, self.rows - at))

    def replace(self, pieces: Iterator[np.ndarray]) -> None:
        """Write pieces to the other file, which is then the one that is read."""
        rows = 0
        self.other.seek(0)
        for piece in pieces:
            self.other.write(memoryview(piece).cast("B"))
            rows += len(piece)
        self.file, self.other, self.rows = self.other, self.file, rows

    def close(self) -> None:
        self.file.close()
        self.other.close()


def _ordered(symbol: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """Places by symbol, then place, as numbers with the symbol above so many bits of place."""
    kind, bits = (np.uint32, 24) if symbols <= 256 and len(symbol) <= 1 << 24 else (np.uint64, 40)
    keys = symbol.astype(kind) << kind(bits)
    keys |= np.arange(len(symbol), dtype=kind)
    keys.sort()
    return keys, bits


def column_wise(strings: list[bytes], width: int, piece: int = 1 << 20) -> list[np.ndarray]:
    """For each string, which of its windows another window of the strings equals.

    The Burrows-Wheeler transform of the strings and the common prefixes of neighbours grow by one
    symbol of every string in each round, from the right: the suffix c·s stands where the symbol c
    before s stands among all symbols c, and has one more symbol in common with the suffix before
    it than there is in common between s and the last row before s that has c, too.  Rows are kept in
    sequence, in files of the task's own that live as long as this call: a round reads them once for
    the places of the new rows and once to merge these in, with ``piece`` rows and one row of each
    string in memory.  Common prefixes stop at ``width``.  At last a walk over the finished
    transform, which is in memory then, tells which rows are whose.
    """
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    out = [np.zeros(max(0, x - width + 1), bool) for x in lengths.tolist()]
    if not n:
        return out
    ends = np.cumsum(lengths)
    values, text = np.unique(np.frombuffer(b"".join(strings), np.uint8), return_inverse=True)
    text = (text + 1).astype(np.int16)  # 0 ends a string
    longest, symbols = int(lengths.max()), len(values) + 1
    with tempfile.TemporaryDirectory(prefix="transform-") as folder:
        held = _Sequence(folder, symbols, width, piece)
        last = np.where(lengths > 0, text[np.maximum(ends - 1, 0)], 0)
        held.replace(held.row(last[a : a + piece], np.zeros(min(piece, n - a))) for a in range(0, n, piece))
        total = np.bincount(last, minlength=symbols)
        at, active = np.arange(n), np.arange(n)
        for r in range(1, longest + 1):
            keep = lengths[active] >= r
            active, at = active[keep], at[keep]
            symbol, rank, up, down = _places(held, at, total, width)
            new = n + (np.cumsum(total) - total - total[0])[symbol] + rank
            order = np.argsort(new)
            at, active, up, down = new[order], active[order], up[order], down[order]
            added = np.where(lengths[active] > r, text[np.maximum(ends[active] - r - 1, 0)], 0)
            held.replace(_merged(held, at, held.row(added, up), down))
            total = total + np.bincount(added, minlength=symbols)
        held.piece = held.rows
        ((_, rows),) = held.pieces()
        held.close()
    shared = held.common(rows) >= width
    shared[:-1] |= shared[1:]
    keys, bits = _ordered(held.symbols(rows), symbols)
    step = np.empty(len(rows), np.int32)
    step[keys & keys.dtype.type((1 << bits) - 1)] = np.arange(len(rows), dtype=np.int32)
    step += n - int(total[0])
    at, active = np.arange(n), np.arange(n)
    for r in range(1, longest + 1):
        keep = lengths[active] >= r
        active, at = active[keep], step[at[keep]]
        for i in active[shared[at]].tolist():
            out[i][lengths[i] - r] = True
    return out


def _places(held: _Sequence, at: np.ndarray, total: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For rows ``at`` (ascending): their symbol, how often rows before have it, and one more than
    the common prefix with the last row before and with the next row behind that has it (0 without).
    ``total``: how many rows have each symbol."""
    far, whole, symbols = 1 << 30, held.rows <= held.piece, len(total)  # whole: nothing is carried from piece to piece
    symbol, rank, up, down = (np.zeros(len(at), np.int64) for _ in range(4))
    seen = np.zeros(symbols, np.int64)
    since = np.full(symbols, far)  # least common prefix behind a symbol's last row
    waits = np.full(symbols, -1)  # which of ``at`` is a symbol's last row
    for begin, rows in held.pieces():
        row, common = held.symbols(rows), held.common(rows)
        lo, hi = np.searchsorted(at, [begin, begin + len(rows)])
        keys, bits = _ordered(row, symbols)
        of = lambda i, keys=keys, bits=bits: (keys[i] & keys.dtype.type((1 << bits) - 1)).astype(np.int64)
        counts = total if whole else np.bincount(row, minlength=symbols)
        base = np.cumsum(counts) - counts
        if not whole:
            there = np.flatnonzero(counts)
            first, final = of(base[there]), of(base[there] + counts[there] - 1)
            reach = np.minimum.accumulate(common)
            least = np.minimum(since[there], reach[first])
            waiting = waits[there] >= 0
            down[waits[there[waiting]]] = np.minimum(least[waiting] + 1, width)
            waits[there] = -1
        place = at[lo:hi] - begin
        if len(place):
            own = row[place].astype(np.int64)
            j = np.searchsorted(keys, ((own << bits) | place).astype(keys.dtype))
            symbol[lo:hi], rank[lo:hi] = own, seen[own] + j - base[own]
            head, tail = j == base[own], j == base[own] + counts[own] - 1
            ahead, behind = of(np.maximum(j - 1, 0)), of(np.minimum(j + 1, len(rows) - 1))
            up[lo:hi] = np.where(head, 0, np.minimum(_least(common, ahead + 1, place + 1, ~head) + 1, width))
            down[lo:hi] = np.where(tail, 0, np.minimum(_least(common, place + 1, behind + 1, ~tail) + 1, width))
            if not whole:
                carried = head & (seen[own] > 0)
                up[lo:hi][carried] = np.minimum(np.minimum(since[own], reach[place]) + 1, width)[carried]
                waits[own[tail]] = lo + np.flatnonzero(tail)
        if not whole:
            left = np.append(np.minimum.accumulate(common[::-1])[::-1].astype(np.int64), far)
            since = np.minimum(since, left[0])
            since[there] = left[final + 1]
            seen += counts
    return symbol, rank, up, down


def _merged(held: _Sequence, at: np.ndarray, added: np.ndarray, down: np.ndarray) -> Iterator[np.ndarray]:
    """The rows with ``added`` ones, which stand at ``at`` (ascending) in the end; ``down``: common
    prefixes of the rows behind them."""
    before = at - np.arange(len(at))  # the old row that each comes before
    final = np.append(before[1:] != before[:-1], True) & (down > 0)
    for begin, rows in held.pieces():
        stop = begin + len(rows) + (begin + len(rows) == held.rows)
        lo, hi = np.searchsorted(before, [begin, stop])
        next_to = lo + np.flatnonzero(final[lo:hi])
        place = before[next_to] - begin
        rows[place] = held.row(held.symbols(rows[place]), down[next_to])
        yield np.insert(rows, before[lo:hi] - begin, added[lo:hi])


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Minimum of values[begin:end] where wanted, else 0."""
    out = np.zeros(len(begin), np.int64)
    some = np.flatnonzero(wanted)
    if len(some):
        some = some[np.argsort(begin[some], kind="stable")]
        pairs = np.empty(2 * len(some), np.int64)
        pairs[::2], pairs[1::2] = begin[some], end[some]
        if pairs.max() == len(values):
            values = np.append(values, values[-1:])
        out[some] = np.minimum.reduceat(values, pairs)[::2]
    return out


def _may_share(strings: list[bytes], offsets: np.ndarray, width: int, part: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in each string windows that another string has can lie: begin and end, equal if nowhere.

    A window has its minimiser x symbols behind its beginning, and for the multiple g of ``step``
    below x it holds the ``width - step`` symbols that begin g before the minimiser.  If no other
    string of the bucket has these, no other has the window."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    places = range(0, width - part + 1, step)
    spans = [(offsets - g, offsets - g + min(width - step, width - g)) for g in places]
    inside = [np.flatnonzero((low >= 0) & (high <= lengths)) for low, high in spans]
    keys: list[list[np.ndarray]] = [[] for _ in places]
    edges = np.searchsorted(np.cumsum(lengths), np.arange(0, int(lengths.sum()) + _AT_ONCE, _AT_ONCE)).tolist()
    for a, b in zip(edges, [*edges[1:], n]):
        base = np.cumsum(lengths[a:b]) - lengths[a:b]
        rolling = Rolling(np.frombuffer(b"".join(strings[a:b]), np.uint8))
        for own, (low, high), some in zip(keys, spans, inside):
            some = some[np.searchsorted(some, a) : np.searchsorted(some, b)]
            own.append(rolling.of(base[some - a] + low[some], base[some - a] + high[some]))
    begin, end = lengths.copy(), np.zeros(n, np.int64)
    for g, own, some in zip(places, keys, inside):
        if len(some):
            _, which, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            some = some[often[which] > 1]
            begin[some] = np.minimum(begin[some], np.maximum(0, offsets[some] - g - step + 1))
            end[some] = np.maximum(end[some], np.minimum(lengths[some], offsets[some] - g + width))
    return np.minimum(begin, end), end


def suffix_blocks(width: int, part: int, block: int = 300_000, step: int = 12) -> Judge:
    """Finds shared windows of bytes by the transform of the strings that share a minimiser.

    Equal windows share their minimiser and most of what surrounds it, so parts of strings for which
    no other string has that need no round.  The others form blocks of whole minimiser groups, of
    about ``block`` symbols or one group, the groups with the shortest strings first: a block takes
    as many rounds as its longest string has symbols."""

    def judge(strings: list[bytes], groups: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        _, group, members = np.unique(groups, return_inverse=True, return_counts=True)
        several = np.flatnonzero(members[group] > 1)  # equal windows share a group, and one string has none twice
        begin, end = np.zeros((2, len(strings)), np.int64)
        begin[several], end[several] = _may_share([strings[i] for i in several.tolist()], offsets[several], width, part, step)
        order = np.flatnonzero(end - begin >= width)
        _, which = np.unique(groups[order], return_inverse=True)
        longest = np.zeros(len(order), np.int64)
        np.maximum.at(longest, which, (end - begin)[order])
        order = order[np.lexsort((which, longest[which]))]
        cuts = np.flatnonzero(np.append(True, np.diff(groups[order]) != 0)) if len(order) else ()
        masks: dict[int, np.ndarray] = {}
        some: list[int] = []
        size = 0
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            some += order[a:b].tolist()
            size += int((end - begin)[order[a:b]].sum())
            if size > block or b == len(order):
                for i, mask in zip(some, column_wise([strings[i][begin[i] : end[i]] for i in some], width)):
                    if mask.any():
                        masks[i] = np.zeros(len(strings[i]) - width + 1, bool)
                        masks[i][begin[i] : begin[i] + len(mask)] = mask
                some, size = [], 0
        return masks

    return judge


# ------------------------------------------------------------------------------ operators

WORD_PLAN = Plan(width=35, part=6, words=True, per_bucket=1_500_000)
BYTE_PLAN = Plan(width=200, part=32, words=False, per_bucket=4_000_000)


def _with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with ``spans``: all of a text's spans, null without any.  Texts travel compressed."""

    def squeezed(batches) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part, chunk in text_chunks(batches, 8 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([squeeze.compress(x) for x in chunk], pa.binary())], ["doc_id", "key_a", "key_b", "text"])

    held = spans.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    sent = texts.select("doc_id", "key_a", "key_b", "text").mapInArrow(squeezed, f"doc_id {type_of(texts, 'doc_id')}, key_a long, key_b long, text binary")
    return sent.join(held, ["key_a", "key_b"], "left")


def _cut_rows(texts: DataFrame, cut: Callable[[bytes, np.ndarray], tuple], counts: list[str], whole: bool) -> DataFrame:
    """Apply ``cut(text, spans)``, which returns counts and the kept bytes; ``whole``: with the kept
    text and the spans removed, else their digest only leaves the task."""
    schema = f"doc_id {type_of(texts, 'doc_id')}, " + ", ".join(f"{c} long" for c in counts) + ", kept_sha256 string" + ", kept string, removed array<struct<begin:int,end:int>>" * whole
    pair = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    kinds = [*(pa.int64() for _ in counts), pa.string(), *(pa.string(), pair)[: 2 * whole]]
    names = ["doc_id", *counts, "kept_sha256", *("kept", "removed")[: 2 * whole]]

    def rows(batches) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch, chunk in text_chunks(batches, 2 << 20):
            out = []
            for text, spans in zip(map(opened.decompress, chunk), batch.column(batch.schema.get_field_index("spans"))):
                flat = np.zeros((0, 2), np.int64)
                if spans.is_valid:
                    v = spans.values
                    flat = union(np.stack([v.field("begin").to_numpy(), v.field("end").to_numpy()], axis=1))
                numbers, kept = cut(text, flat)
                more = (kept.decode("utf-8", "replace"), [{"begin": a, "end": b} for a, b in flat.tolist()]) if whole else ()
                out.append((*numbers, hashlib.sha256(kept).hexdigest(), *more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    return texts.select("doc_id", "text", "spans").mapInArrow(rows, schema)  # texts as _with_spans sends them


def remove_repeated_words(docs: DataFrame, plan: Plan = WORD_PLAN, whole: bool = True) -> DataFrame:
    """Remove the words covered by windows (35 words) that also start anywhere else.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, if ``whole``, ``kept, removed`` for each
    row: ``kept`` are the other words joined by one space, ``removed`` the maximal removed runs of words.

    Exact: super-k-mers go to their minimiser's bucket (see the module) where sorting counts the
    windows.  All copies of a window go, the first included.  Texts of over 4 MB are hashed in
    overlapping pieces; a task holds each whole text, and its words, once when it is cut.  Null, empty and blank texts have no
    words; texts shorter than a window keep all; equal rows are copies of each other and lose all
    their windows; an empty table gives no rows; other columns are ignored.
    """
    texts = keyed(docs)

    def cut(text: bytes, spans: np.ndarray) -> tuple:
        words = text.split()
        kept, at = [], 0
        for a, b in spans.tolist():
            kept += words[at:a]
            at = b
        kept += words[at:]
        return (len(words), len(words) - len(kept)), b" ".join(kept)

    spans = repeated_spans(texts, plan, sorted_windows(plan.width))
    return _cut_rows(_with_spans(texts, spans), cut, ["n_words", "n_removed"], whole)


def remove_repeated_bytes(docs: DataFrame, plan: Plan = BYTE_PLAN, whole: bool = True) -> DataFrame:
    """Remove the bytes covered by strings (200 bytes) that also start anywhere else.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if ``whole``, ``kept, removed``
    for each row.  The digest is of the kept bytes; ``kept`` shows them as text (a character that a cut divided reads
    as U+FFFD).

    Exact: the collection is divided by minimiser, and each part's multi-document suffix order is
    built column-wise (``column_wise``).  Texts of over 4 MB are hashed in overlapping pieces; a task
    holds each whole text when it is cut.  Null texts are empty; texts shorter than the string keep
    all; equal rows are copies of each other; an empty table gives no rows; other columns are
    ignored.
    """
    texts = keyed(docs)

    def cut(text: bytes, spans: np.ndarray) -> tuple:
        kept, at = [], 0
        for a, b in spans.tolist():
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        rest = b"".join(kept)
        return (len(text), len(text) - len(rest), len(spans)), rest

    spans = repeated_spans(texts, plan, suffix_blocks(plan.width, plan.part))
    return _cut_rows(_with_spans(texts, spans), cut, ["n_bytes", "n_removed", "n_spans"], whole)
