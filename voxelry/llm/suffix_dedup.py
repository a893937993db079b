"""Removal of long repeated byte strings with suffix arrays built by linear grouping.

A suffix array of a whole corpus has no place on one machine, so strings that can be equal are first brought
together. Every window of 400 bytes has an anchor, the 128-byte string in it with the least hash (the first,
if several); equal windows have equal anchors at equal places. A run is a stretch of neighbouring windows
with one anchor occurrence, a segment its bytes.

* Segments that occur more than once are repeated throughout.
* Unlike segments with one anchor are compared by a suffix array over cells of 16 bytes counted from the
  anchor. It is built by grouping suffixes by their Lyndon prefixes, in descending order and with pointers to
  the previous smaller suffix, and then emitting the groups' order: no recursion and no renaming. Suffixes
  that share 24 cells are neighbours; their windows are equal if the 16 bytes around those cells are.
* A group of more than ``MOST`` unlike segments would make a large task, so it is refined until its parts are
  small enough: its windows fall into stretches (``WIDTHS``) by how far they reach to the left of the anchor; all
  windows of a stretch hold the same, longer string around the anchor, and a segment goes on with each stretch
  under that string as its new group. Segments that are alike in a stretch are repeated there, and one of them
  goes on. A stretch narrows to one window in the end, where a group is alike; on the way, a segment stays in
  the stretches that hold the ends of what it shares, so rows grow with the segments, not with their pairs.

All of it is exact up to 128-bit hashes of texts, segments and groups.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, packed_by_key, row_key, unpacked, written
from .ngram_join import by_group

LENGTH, ANCHOR, CELL = 400, 128, 16
SPAN = LENGTH - ANCHOR + 1
CELLS = LENGTH // CELL - 1
#: Unlike segments that one suffix array takes, at most 672 bytes each; windows of a stretch, round by round.
MOST, WIDTHS = 1024, (64, 16, 4, 1)
#: A kind of more than this part of all rows is broadcast, so there are fewer of them than this.
PARTS = 4096
_CHUNK = 1 << 20
_rng = np.random.default_rng(9)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 22) - 1)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        for b in (base, inverse):
            p = np.full(_CHUNK + LENGTH, np.uint64(b))
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def runs(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(first window, windows, anchor) of each run, all as byte places. Long texts are read in chunks."""
    up, down = _power_tables()
    for begin in range(0, len(data) - LENGTH + 1, _CHUNK):
        part = np.frombuffer(data[begin : begin + _CHUNK + LENGTH - 1], np.uint8)
        n, k = len(part), len(part) - ANCHOR + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:n], out=total[1:])
        h = (total[ANCHOR:] - total[:k]) * down[:k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        key = ((h ^ (h >> np.uint64(32))) & ~_LOW) | np.arange(k, dtype=np.uint64)
        rows = -(-k // SPAN)
        padded = np.full(rows * SPAN, ~np.uint64(0))
        padded[:k] = key
        blocks = padded.reshape(rows, SPAN)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - LENGTH + 1
        least = (np.minimum(back[:windows], ahead[SPAN - 1 : SPAN - 1 + windows]) & _LOW).astype(np.int64)
        starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        for a, z in zip(starts.tolist(), np.append(starts[1:], windows).tolist()):
            yield begin + a, z - a, begin + int(least[a])


_KIND = ["g1", "g2", "s1", "s2"]
_RUN = [*_KIND, "times", *KEY, "p", "n", "back"]


def _digests(data: list[bytes]) -> np.ndarray:
    """Two columns of 64 bits."""
    return np.frombuffer(b"".join(data), "<i8").reshape(-1, 2)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each kind of segment of a text, with its times there. Segments that a text repeats are settled: the
    bytes they cover come as rows without a kind, however many segments a periodic text has."""
    digest = xxhash.xxh3_128_digest
    none = bytes(32)
    for b in batches:
        hashes: list[bytes] = []
        out: list[list[int]] = [[] for _ in range(6)]
        for k1, k2, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            if data is None or len(data) < LENGTH:
                continue
            kinds: dict[bytes, list[int]] = {}
            twice: list[list[int]] = []
            for start, n, anchor in runs(data):
                name = digest(data[anchor : anchor + ANCHOR]) + digest(data[start : start + n + LENGTH - 1], anchor - start)
                if (seen := kinds.get(name)) is None:
                    kinds[name] = [1, start, n, anchor - start]
                    continue
                seen[0] += 1
                for at in (seen[1], start) if seen[0] == 2 else (start,):
                    if twice and twice[-1][0] <= at <= twice[-1][1]:
                        twice[-1][1] = max(twice[-1][1], at + n - 1 + LENGTH)
                    else:
                        twice.append([at, at + n - 1 + LENGTH])
            rows = [(name, *x) for name, x in kinds.items()] + [(none, 0, a, z - a - LENGTH + 1, 0) for a, z in _merged(twice)]
            hashes += [r[0] for r in rows]
            for v, x in zip(out, zip(*((times, k1, k2, p, n, back) for _, times, p, n, back in rows))):
                v.extend(x)
            if len(out[0]) > 50_000:
                yield _run_batch(hashes, out)
                hashes, out = [], [[] for _ in range(6)]
        yield _run_batch(hashes, out)


def _run_batch(hashes: list[bytes], out: list[list[int]]) -> pa.RecordBatch:
    h = _digests(hashes).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(h[:, i])) for i in range(4)), *(pa.array(v, pa.int64()) for v in out)], _RUN)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a text of non-negative integers, by linear grouping.

    First pass: groups of suffixes with one first symbol, processed from the largest. For each member the
    previous suffix in a smaller group is found through pointers already set; these previous suffixes leave
    their groups, those pointed to most often last, for new groups right behind. What remains are the groups
    of suffixes with one Lyndon prefix. Second pass: in order of the suffix array as it fills, the suffix
    before an entry, and its chain of previous smaller suffixes, take the next places of their groups."""
    text = [x + 1 for x in text] + [0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    slot, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for r, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = r
        slot[i], group[i] = r, start
        size[start] += 1
    prev = [-2] * n  # -2: not known yet, -1: none
    end = n
    while end:
        start = group[order[end - 1]]
        members = order[start:end]
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j] if prev[j] != -2 else j - 1
            prev[i] = j
        pointed = Counter(prev[i] for i in members)
        pointed.pop(-1, None)
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            touched: dict[int, list[int]] = {}
            for j in by_count[c]:
                g = group[j]
                size[g] -= 1
                last = g + size[g]
                other, at = order[last], slot[j]
                order[last], order[at] = j, other
                slot[j], slot[other] = last, at
                touched.setdefault(g, []).append(j)
            for g, moved in touched.items():
                new = g + size[g]
                size[new] = len(moved)
                for j in moved:
                    group[j] = new
        end = start
    out, following, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[following[g]] = j
            following[g] += 1
            placed[j] = True
            j = prev[j]
    return out[1:]


def repeated_windows(segments: list[tuple[int, bytes, int, int]]) -> list[np.ndarray]:
    """For each segment (group, bytes, windows, anchor's place), which of its windows another segment of its
    group holds at the same place."""
    buffer = np.frombuffer(b"".join(s[1] for s in segments), np.uint8)
    at = np.cumsum([0] + [len(s[1]) for s in segments])
    n_cells = np.array([(len(s[1]) - s[3] % CELL) // CELL for s in segments])
    owner = np.repeat(np.arange(len(segments)), n_cells)
    nth = np.arange(n_cells.sum()) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
    back = np.array([s[3] for s in segments])
    inside = nth * CELL + (back % CELL)[owner]  # of the cell, in its segment
    place = at[:-1][owner] + inside
    record = np.zeros((len(owner), 32), np.uint8)
    record[:, :8] = np.array([s[0] for s in segments], np.int64)[owner].view(np.uint8).reshape(-1, 8)
    record[:, 8:16] = ((inside - back[owner]) // CELL).astype(np.int64).view(np.uint8).reshape(-1, 8)
    record[:, 16:] = buffer[place[:, None] + np.arange(CELL)]
    _, symbol = np.unique(record.view("V32").ravel(), return_inverse=True)
    # one text: segments ended by symbols of their own
    ends = np.cumsum(n_cells + 1) - 1
    text = np.empty(len(owner) + len(segments), np.int64)
    cell_at = np.arange(len(owner)) + owner
    text[cell_at] = symbol
    text[ends] = len(owner) + np.arange(len(segments))
    sa = np.array(suffix_array(text.tolist()))
    padded = np.append(text, np.full(CELLS, -1))
    near = np.ones(len(sa) - 1, bool)
    for c in range(CELLS):
        near &= padded[sa[1:] + c] == padded[sa[:-1] + c]
    shared = np.empty(len(sa), np.int64)
    shared[sa] = np.append(0, np.cumsum(~near))
    alike = np.append(False, near) | np.append(near, False)
    paired = np.empty(len(sa), bool)
    paired[sa] = alike
    pick = np.flatnonzero(paired[cell_at])
    # windows whose first whole cell is a picked one: t bytes before the cells, 16 - t behind them
    t = np.tile(np.arange(CELL), len(pick))
    cell = np.repeat(pick, CELL)
    first = inside[cell] - t
    ok = (first >= 0) & (first < np.array([s[2] for s in segments])[owner[cell]])
    t, cell, first = t[ok], cell[ok], first[ok]
    q = np.arange(CELL)
    byte = at[:-1][owner[cell]] + first
    rim = buffer[byte[:, None] + np.where(q < t[:, None], q, q + CELLS * CELL)]
    rim = np.ascontiguousarray(rim).view(np.uint64).reshape(-1, 2)
    key = shared[cell_at[cell]] * CELL + t
    order = np.lexsort((rim[:, 1], rim[:, 0], key))
    same = (np.diff(key[order]) == 0) & (rim[order][1:] == rim[order][:-1]).all(axis=1)
    twin = np.zeros(len(order), bool)
    twin[order] = np.append(False, same) | np.append(same, False)
    out = [np.zeros(s[2], bool) for s in segments]
    hit = np.flatnonzero(twin)
    for s, f in zip(owner[cell[hit]].tolist(), first[hit].tolist()):
        out[s][f] = True
    return out


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


_MARK = [*KEY, "a", "z"]
_MARKS = ", ".join(f"{x} long" for x in _MARK)
#: A segment, or the part of it in one stretch: its group, its own digest, the rows that are like it (times), its
#: text, first window, windows, the anchor's place in it, and its bytes.
_PIECE = _RUN
_PIECES = ", ".join(f"{x} long" for x in _PIECE) + ", bytes binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unlike pieces sorted by group -> repeated bytes of those that occur once."""
    held: list[tuple[int, bytes, int, int]] = []
    info: list[tuple[int, int, int, int]] = []
    size = 0

    def settle() -> pa.RecordBatch:
        marks = []
        for (k1, k2, p, times), flags in zip(info, repeated_windows(held)):
            if times == 1:
                marks += [(k1, k2, p + a, p + a + n - 1 + LENGTH) for a, n in intervals(flags)]
        held.clear()
        info.clear()
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in marks], pa.int64()) for i in range(4)], _MARK)

    number = 0
    for g in by_group(batches, ["g1", "g2"]):
        number += 1
        for times, k1, k2, p, n, back, data in zip(*(g.column(x).to_pylist() for x in ("times", *KEY, "p", "n", "back", "bytes"))):
            held.append((number, data, n, back))
            info.append((k1, k2, p, times))
            size += len(data)
        if size > 1 << 19:
            yield settle()
            size = 0
    if held:
        yield settle()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        rows = []
        for k1, k2, data, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (k1, k2) != last:  # not for every copy of a row
                last = (k1, k2)
                rows += [(w, data[w["p"] : w["p"] + w["n"] + LENGTH - 1]) for w in wanted]
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            cols = [pa.array([w[x] for w, _ in part], pa.int64()) for x in _PIECE]
            bytes_, many = pa.array([d for _, d in part], pa.binary()), pa.array([w["many"] for w, _ in part])
            yield pa.RecordBatch.from_arrays([*cols, bytes_, many], [*_PIECE, "bytes", "many"])


def _refine(width: int):
    """Pieces -> their parts in stretches of ``width`` windows, by the windows' reach to the left of the anchor."""
    digest = xxhash.xxh3_128_digest

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, rows, cut = [], [], []
            for times, k1, k2, p, n, back, data in zip(*(b.column(x).to_pylist() for x in ("times", *KEY, "p", "n", "back", "bytes"))):
                for q in range((back - n + 1) // width, back // width + 1):
                    near, far = q * width, q * width + width - 1  # reach of the stretch's last and first window
                    first, last = max(0, back - far), min(n - 1, back - near)
                    inner = data[back - near : back - far + LENGTH]  # in all windows of the stretch
                    part = data[first : last + LENGTH]
                    hashes += (digest(inner, q), digest(part, back - first))
                    rows.append((times, k1, k2, p + first, last - first + 1, back - first))
                    cut.append(part)
            h = _digests(hashes).reshape(-1, 4)
            cols = [pa.array(np.ascontiguousarray(h[:, i])) for i in range(4)] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.binary())], [*_PIECE, "bytes"])

    return parts


def _among(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows whose kind is in ``kinds``, which has the number of its ``rows``. Those of frequent kinds stay where
    they are: shuffled, all copies of one segment would meet in a task."""
    most = rows.count() // PARTS
    frequent = F.broadcast(kinds.where(F.col("rows") > most).select(*_KIND))
    others = kinds.where(F.col("rows") <= most).select(*_KIND)
    rest = rows.join(frequent, _KIND, "left_anti").join(others, _KIND, "left_semi")
    return rows.join(frequent, _KIND, "left_semi").unionByName(rest)


def _shared(rows: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose kind occurs again, and a row for each kind of a group of unlike kinds, with ``many``: whether
    the group has more than one suffix array takes."""
    one = F.min(F.struct(*KEY, "p", "n", "back", *kept)).alias("one")
    kinds = rows.groupBy(*_KIND).agg(F.sum("times").alias("times"), F.count("*").alias("rows"), one)
    groups = kinds.groupBy("g1", "g2").agg(F.count("*").alias("kinds"), F.sum("times").alias("total")).where("total > 1").drop("total")
    shared = written(kinds.join(groups, ["g1", "g2"]).select(*_KIND, "kinds", "times", "rows", "one.*"), "suffix-shared")
    again = _among(rows, shared.where("times > 1"))
    return again, shared.where("kinds > 1").select(*_PIECE, *kept, (F.col("kinds") > MOST).alias("many"))


def _whole(rows: DataFrame) -> DataFrame:
    """Marks of rows that are repeated throughout."""
    return rows.select(*KEY, F.col("p").alias("a"), (F.col("p") + F.col("n") - 1 + LENGTH).alias("z"))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(k1, k2, a, z): bytes a to z of the text are covered by repeated windows."""
    source = docs.select(*row_key(), F.col("text").cast("binary").alias("data")).where(F.octet_length("data") >= LENGTH)
    found = written(source.mapInArrow(_run_rows, ", ".join(f"{x} long" for x in _RUN)), "suffix-runs")
    copies, unlike = _shared(found.where("times > 0"))
    marks = [_whole(copies), _whole(found.where("times = 0"))]
    wanted = unlike.groupBy(*KEY).agg(F.collect_list(F.struct(*_PIECE, "many")).alias("wanted"))
    pieces = written(source.join(wanted, KEY).select(*KEY, "data", "wanted").mapInArrow(_segments, f"{_PIECES}, many boolean"), "suffix-segments")
    for width in WIDTHS:
        marks.append(pieces.where("NOT many").repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_compare, _MARKS))
        large = pieces.where("many").drop("many")
        if large.isEmpty():
            break
        copies, pieces = _shared(written(large.mapInArrow(_refine(width), _PIECES), "suffix-parts"), "bytes")
        marks.append(_whole(copies))
    return reduce(DataFrame.unionByName, marks)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted by row and place -> a row's maximal spans, in order; one row's are held, merged as they come."""
    key, held = None, []
    out: list[list] = [[], [], []]

    def flush() -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], [*KEY, "spans"])
        for v in out:
            v.clear()
        return batch

    def close() -> None:
        if key is not None:
            for v, x in zip(out, (*key, [{"a": a, "z": z} for a, z in held])):
                v.append(x)

    for b in batches:
        for k1, k2, a, z in zip(*(b.column(i).to_pylist() for i in range(4))):
            if key != (k1, k2):
                close()
                key, held = (k1, k2), []
            if held and a <= held[-1][1]:
                held[-1][1] = max(held[-1][1], z)
            else:
                held.append([a, z])
        if len(out[0]) > 5000:
            yield flush()
    close()
    if out[0]:
        yield flush()


def _marked(docs: DataFrame) -> DataFrame:
    ends = repeated_bytes(docs).groupBy(*KEY, "a").agg(F.max("z").alias("z"))
    spans = ends.repartition(*KEY).sortWithinPartitions(*KEY, "a").mapInArrow(_spans, "k1 long, k2 long, spans array<struct<a:bigint,z:bigint>>")
    return packed_by_key(docs).join(spans, KEY, "left")


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Every byte covered by a 400-byte string of a text that also starts elsewhere, in the same text or in another
    row's, is removed; strings are judged on the input. Null text is empty; texts under 400 bytes lose nothing.
    Repeated rows are copies of each other; null or repeated doc_ids are fine. Other columns are ignored; an
    empty table gives none."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data, gone = data or b"", [(x["a"], x["z"]) for x in spans or ()]
                kept, at = hashlib.sha256(), 0
                for a, z in gone:
                    kept.update(data[at:a])
                    at = z
                kept.update(data[at:])
                rows.append((len(data), sum(z - a for a, z in gone), len(gone), kept.hexdigest()))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _marked(docs.select("doc_id", "text")).select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("binary").alias("data"), "spans")
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` in its own columns, texts without repeated bytes; null stays null. A character that loses some of
    its bytes, at the rim of a repeated string, goes altogether."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if text is None or found is None or not len(found):
                return text
            data, gone, at = text.encode(), [(x["a"], x["z"]) for x in found], 0
            parts = []
            for a, z in gone:
                parts.append(data[at:a])
                at = z
            return (b"".join(parts) + data[at:]).decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    out = _marked(docs).select("doc", cut(F.col("doc.text"), F.col("spans")).alias("kept"))
    return unpacked(out, docs, text=F.col("kept"))
