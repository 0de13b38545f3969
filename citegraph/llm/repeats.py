"""Suffix-array removal of byte strings that repeat across documents.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.

1. Texts are packed into blocks. Every window of LENGTH bytes names the smallest hash of its GRAM-byte strings, at the leftmost place;
   equal windows name equal strings. A block sends the distinct hashes it names to tasks by hash range, which answer which of them
   occur in two documents.
2. For those the block cuts the slice of text whose windows name the place, and sends distinct slices, with the smallest document of the
   block that holds them, to tasks by the same ranges. All copies of a window meet there. Where the slices lie, the block sends to itself.
3. Such a task puts the slices of one named string into one text and sorts the suffixes of its texts by linear grouping (``lyndon``). Neighbours
   that agree in LENGTH bytes are copies; the smallest document of each run of copies decides, for every slice that was sent, which of
   its windows go. Windows that no other slice holds are left out beforehand by their hash: of equal slices the smallest document is known.
4. The block removes what the answers cover.

Blocks bound what a task holds of the texts. A slice is sent once per block, however many copies the block has, and a named string with
more than ``WIDE`` distinct slices is sorted window by window, each distinct window once, so no text of a task grows with its number.
Texts travel once, with their block; the steps of a block read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, unkeyed
from .lyndon import ranges, suffix_arrays

# Fixed value of the contract.
LENGTH = 50
GRAM = 16
PLACES = LENGTH - GRAM + 1
LONGEST = LENGTH + PLACES - 1
WIDE = 48
# Windows sorted in one text where they are sorted by themselves; texts of a batch advance together, so short ones take fewer steps.
WINDOWS = 8
BLOCK_BYTES = 4_000_000
# Every block writes to every range, so larger ranges keep the number of messages down; a task takes a range in pieces.
BLOCKS_PER_RANGE = 8
# Bytes of short texts hashed together.
PIECE = 32_768
# Slices handled at a time where they are wide arrays, and slices of a range compared at a time.
CHUNK = 2_048
SLICES = 65_536
# Suffixes sorted at a time.
BATCH = 400_000
LAST = np.iinfo(np.int64).max
_BASE = 0x100000001B3
_powers: dict[int, np.uint64] = {}


def power(n: int) -> np.uint64:
    if n not in _powers:
        _powers[n] = np.uint64(pow(_BASE, n, 2**64))
    return _powers[n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def evened(h: np.ndarray) -> np.ndarray:
    """Named hashes are the smallest of many and lie low; mixed once more they fill all ranges evenly and stay distinct."""
    return mixed(h ^ np.uint64(0x5851F42D4C957F2D))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place; GRAM is a power of two, so widths are doubled."""
    h, width = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < GRAM:
        n = len(h) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = h[:n] * power(width) + h[width:width + n]
        width *= 2
    return mixed(h)


def named_places(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places named by the windows of texts that lie one after the other in ``raw``, their hashes, and the first and last window that names each."""
    windows = ranges(np.cumsum(sizes) - sizes, np.maximum(sizes - (LENGTH - 1), 0))
    if not len(windows):
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, empty
    h = gram_hashes(raw)
    # The smallest (hash, place) per window by doubling widths; the low bits hold the place, so the leftmost of equals is named.
    bits = np.uint64(max(24, int(len(h)).bit_length()))
    low, width = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(raw) - LENGTH + 1
    low = np.minimum(low[:n], low[PLACES - width:PLACES - width + n])
    # Windows over the edge of a text are none.
    place = (low[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    places = place[at]
    return places, evened(h[places]), windows[at], windows[np.append(at[1:], len(place)) - 1]


def ranged(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of known kinds as one compressed value: their lengths in bytes, then their bytes."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw))


def unpacked(value: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def text_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Numbered frames of about BLOCK_BYTES."""
    from pyspark import TaskContext

    number, held, total = TaskContext.get().partitionId() << 24, [], 0
    for frame in frames:
        start = 0
        for at, raw in enumerate(frame["raw"]):
            total += len(raw) + 100
            if total >= BLOCK_BYTES:
                yield number, pd.concat([*held, frame.iloc[start:at + 1]], ignore_index=True)
                number, held, total, start = number + 1, [], 0, at + 1
        if start < len(frame):
            held.append(frame.iloc[start:])
    if held:
        yield number, pd.concat(held, ignore_index=True)


def block_places(texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document number, hash, slice start within the block and slice length of all named places of a block, and the place in its slice."""
    ends = np.cumsum(sizes)
    piece = (ends - sizes) // PIECE
    cuts = [*np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(sizes)] if len(sizes) else [0]
    hashes, starts, lengths, offsets = [np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        base = ends[a] - sizes[a]
        places, h, first, last = named_places(texts[base:ends[b - 1]], sizes[a:b])
        hashes.append(h)
        starts.append(first + base)
        lengths.append(last - first + LENGTH)
        offsets.append(places - first)
    start = np.concatenate(starts)
    return np.searchsorted(ends, start, "right"), np.concatenate(hashes), start, np.concatenate(lengths), np.concatenate(offsets)


def shared_in_block(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes, and whether two documents of the block name each."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(head)
    if not len(at):
        return h, np.zeros(0, bool)
    return h[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)


def named_in_two(blocks: DataFrame, ranges_: int, bits: int) -> DataFrame:
    """Rows (block, part, flags): for the block's distinct hashes of a range, whether two documents name them. ``bits`` of a hash are compared."""
    drop = np.uint64(64 - bits)

    def local(key, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in frame["payload"]:
            _, _, sizes, texts = unblocked(payload)
            doc, hashes, *_ = block_places(texts, sizes)
            found, both = shared_in_block(doc, hashes)
            cuts = np.searchsorted(ranged(found, ranges_), np.arange(ranges_ + 1))
            short = found >> drop
            for p in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[p], cuts[p + 1])
                gaps = np.diff(short[s], prepend=np.uint64(0))
                out.append((p, packed(gaps[:1], gaps[1:].astype(np.uint32) if gaps[1:].max(initial=0) < 2**32 else gaps[1:], both[s])))
        return pd.DataFrame({"block": key[0], "part": [p for p, _ in out], "hashes": [h for _, h in out]})

    def answered(key, frame: pd.DataFrame) -> pd.DataFrame:
        hashes, both = [], []
        for value in frame["hashes"]:
            head, gaps, flags = unpacked(value, np.uint64, np.uint8, np.bool_)
            kind = np.uint32 if len(gaps) == 4 * (len(flags) - 1) else np.uint64
            hashes.append(np.cumsum(np.concatenate([head, gaps.view(kind).astype(np.uint64)]), dtype=np.uint64))
            both.append(flags)
        every = np.concatenate(hashes)
        # A block sends a hash once, so one that comes twice is named in two blocks.
        by = np.argsort(every)
        head = np.append(True, every[by][1:] != every[by][:-1])
        at = np.flatnonzero(head)
        seen = np.diff(np.append(at, len(every)))
        yes = np.empty(len(every), bool)
        yes[by] = np.repeat((seen > 1) | np.logical_or.reduceat(np.concatenate(both)[by], at), seen)
        flags = np.split(yes, np.cumsum([len(h) for h in hashes])[:-1])
        return pd.DataFrame({"block": frame["block"], "part": frame["part"], "flags": [packed(f) for f in flags]})

    return blocks.groupBy("block").applyInPandas(local, "block long, part int, hashes binary").groupBy("part").applyInPandas(
        answered, "block long, part int, flags binary")


def rows_of(texts: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Slices as rows of ``width`` bytes, zero behind their ends."""
    out = sliding_window_view(np.append(texts, np.zeros(width, np.uint8)), width)[start]
    out[np.arange(width) >= size[:, None]] = 0
    return out


def row_hash(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64)
    fours = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).view(np.uint32)
    for at in range(0, len(rows), CHUNK):
        part = h[at:at + CHUNK]
        for j, four in enumerate(fours[at:at + CHUNK].T.astype(np.uint64, order="C")):
            part = (part + four + np.uint64(4 * j)) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(29)
        h[at:at + CHUNK] = part
    return mixed(h)


def ends_of(raw: bytes, removed: np.ndarray | None) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the hash of what is left."""
    if removed is None or not removed.any():
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    spans = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
    kept = np.frombuffer(raw, np.uint8)[~removed]
    return len(raw), int(removed.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()


RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
# What a block keeps for itself (kind 1, ``at`` is the block) and slices for a hash range (kind 2, ``at`` is the range).
STATE = "kind int, at long, block long, payload binary"


def cut_slices(blocks: DataFrame, flags: DataFrame, ranges_: int) -> DataFrame:
    """Per block: where its shared slices lie (kind 1) and the distinct slices themselves by hash range (kind 2)."""
    def cut(key, frame: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in frame["payload"] if len(reply) else ():
            _, order, sizes, texts = unblocked(payload)
            doc, hashes, start, size, offset = block_places(texts, sizes)
            shared = np.concatenate([unpacked(f, np.bool_)[0] for f in reply.sort_values("part")["flags"]])
            by = np.argsort(hashes)
            ascending = hashes[by]
            use = by[shared[np.cumsum(np.append(True, ascending[1:] != ascending[:-1])) - 1]]
            if not len(use):
                continue
            doc, hashes, start, size, offset = (x[use] for x in (doc, hashes, start, size, offset))
            content = row_hash(rows_of(texts, start, size, LONGEST), size)
            # Equal slices lie together and ranges ascend.
            by = np.argsort(hashes >> np.uint64(40) << np.uint64(40) | mixed(hashes ^ content) >> np.uint64(24))
            doc, hashes, start, size, offset, content = (x[by] for x in (doc, hashes, start, size, offset, content))
            head = np.append(True, (hashes[1:] != hashes[:-1]) | (content[1:] != content[:-1]))
            lead = np.flatnonzero(head)
            least = np.minimum.reduceat(order[doc], lead)
            later = order[doc] > least[np.cumsum(head) - 1]
            out.append((1, key[0], packed(start.astype(np.int32), size.astype(np.uint8), head, later)))
            cuts = np.searchsorted(ranged(hashes[lead], ranges_), np.arange(ranges_ + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                s = lead[cuts[p]:cuts[p + 1]]
                out.append((2, p, packed(
                    cuts[p:p + 1], least[cuts[p]:cuts[p + 1]], size[s].astype(np.uint8), offset[s].astype(np.uint8), texts[ranges(start[s], size[s])])))
        return pd.DataFrame({"kind": [k for k, _, _ in out], "at": [a for _, a, _ in out], "block": key[0], "payload": [v for _, _, v in out]})

    return blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInPandas(cut, STATE)


def copies(text: np.ndarray, size: np.ndarray, owner_text: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per byte of the pieces in ``text``: the smallest document of the window starting there, LAST where no window does.

    Pieces lie one after the other, those of one text (``owner_text``, ascending) together. A
    text is its pieces with separators between, lower than any byte, and an end.
    """
    n = len(size)
    last_of = np.ones(n, bool)
    last_of[:-1] = owner_text[1:] != owner_text[:-1]
    begin = np.cumsum(size + 1) - size - 1
    codes = np.ones(int((size + 1).sum()), np.int16)
    inner = ranges(begin, size)
    codes[inner] = text.astype(np.int16) + 2
    codes[(begin + size)[last_of]] = 0
    edges = np.flatnonzero(last_of)
    lengths = np.diff(np.append(0, (begin + size + 1)[edges]))
    left = np.zeros(len(codes), np.int64)  # bytes of the piece from here on
    left[inner] = np.repeat(size, size) - (np.arange(len(inner)) - np.repeat(np.cumsum(size) - size, size))
    document = np.full(len(codes), LAST)
    document[inner] = np.repeat(doc, size)
    best = np.full(len(codes), LAST)
    order = np.argsort(lengths, kind="stable")
    starts = np.cumsum(lengths) - lengths
    groups = np.cumsum(lengths[order]) // BATCH
    for b in np.unique(groups):
        chosen = order[groups == b]
        at = ranges(starts[chosen], lengths[chosen])
        sa = at[suffix_arrays(codes[at], lengths[chosen])]
        sa = sa[left[sa] >= LENGTH]
        if not len(sa):
            continue
        windows = sliding_window_view(codes, LENGTH)
        new = np.ones(len(sa), bool)
        string = np.searchsorted(starts, sa, "right")
        for part in range(1, len(sa), 200_000):
            s = slice(part, min(part + 200_000, len(sa)))
            before = slice(s.start - 1, s.stop - 1)
            new[s] = (windows[sa[s]] != windows[sa[before]]).any(1) | (string[s] != string[before])
        heads = np.flatnonzero(new)
        low = np.minimum.reduceat(document[sa], heads)
        best[sa] = np.repeat(low, np.diff(np.append(heads, len(sa))))
    return best[inner]


def windows_to_remove(hashes, order, size, rows) -> np.ndarray:
    """For slices (named hash, document, length, bytes as rows): which windows also start in a smaller document."""
    content = row_hash(rows, size)
    by = np.lexsort((order, content, hashes))
    head = np.ones(len(by), bool)
    head[1:] = (hashes[by][1:] != hashes[by][:-1]) | (content[by][1:] != content[by][:-1])
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    lead = by[at]
    doc = order[lead]
    n = len(lead)
    slices, sizes, named = rows[lead], size[lead].astype(np.int64), hashes[lead]
    # Window hashes from running sums of the row. Only windows that another slice holds too are compared: the smallest document with a
    # slice is known.
    window = np.empty((n, PLACES), np.uint64)
    for at in range(0, n, CHUNK):
        # Bytes of one place of all slices lie together here.
        part = np.ascontiguousarray(slices[at:at + CHUNK].T)
        run = np.zeros((LONGEST + 1, part.shape[1]), np.uint64)
        for j in range(LONGEST):
            run[j + 1] = run[j] * power(1) + part[j] + np.uint64(1)
        window[at:at + CHUNK] = mixed(run[LENGTH:] - run[:-LENGTH] * power(LENGTH)).T
    valid = np.arange(PLACES) <= (sizes - LENGTH)[:, None]
    flat = window[valid]
    # Two tables of some bits of repeated hashes let a few others pass too; the suffix arrays decide.
    ascending = np.sort(flat)
    twice = ascending[1:][ascending[1:] == ascending[:-1]]
    low = np.uint64((1 << min(32, max(16, (16 * len(twice)).bit_length()))) - 1)
    table, other = np.zeros((2, int(low) + 1), bool)
    table[twice & low] = True
    other[twice >> np.uint64(32) & low] = True
    candidate = np.zeros((n, PLACES), bool)
    candidate[valid] = table[flat & low] & other[flat >> np.uint64(32) & low]
    best = np.where(valid, doc[:, None], LAST)
    use = candidate.any(1)
    first = candidate.argmax(1)
    last = PLACES - 1 - candidate[:, ::-1].argmax(1)
    runs = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    wide = np.repeat(np.add.reduceat(use.astype(np.int64), runs) > WIDE, np.diff(np.append(runs, n))) & use
    narrow = np.flatnonzero(use & ~wide)
    if len(narrow):
        begin, length = first[narrow], last[narrow] - first[narrow] + LENGTH
        text = slices[np.repeat(narrow, length), ranges(begin, length)]
        string = np.cumsum(np.append(True, named[narrow][1:] != named[narrow][:-1])) - 1
        found = copies(text, length, string, doc[narrow])
        starts = np.cumsum(length) - length
        many = length - LENGTH + 1
        best[np.repeat(narrow, many), ranges(begin, many)] = found[ranges(starts, many)]
    if wide.any():
        r, c = np.nonzero(candidate & wide[:, None])
        w = window[r, c]
        by_w = np.lexsort((doc[r], w))
        head = np.append(True, w[by_w][1:] != w[by_w][:-1])
        lead_w = by_w[head]
        text = slices[np.repeat(r[lead_w], LENGTH), ranges(c[lead_w], np.full(len(lead_w), LENGTH))]
        string = np.arange(len(lead_w)) // WINDOWS
        found = copies(text, np.full(len(lead_w), LENGTH), string, doc[r[lead_w]])[::LENGTH]
        number = np.empty(len(w), np.int64)
        number[by_w] = np.cumsum(head) - 1
        best[r, c] = found[number]
    return best[of] < order[:, None]


def answer_slices(state: DataFrame) -> DataFrame:
    """Rows (kind, block, payload): runs of removed windows per slice as (number in the block, first byte, end byte); kind 1 stays as it is."""
    def answered(key, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] == 1:
            return frame[["kind", "block", "payload"]]
        parts = [unpacked(p, np.int64, np.int64, np.uint8, np.uint8, np.uint8) for p in frame["payload"]]
        order, size, offset, text = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        hashes = np.empty(len(size), np.uint64)
        for at in range(0, len(size), SLICES):
            s = slice(at, at + SLICES)
            h = (sliding_window_view(text, GRAM)[start[s] + offset[s]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            width = 1
            while width < GRAM:
                h = h[:, 0::2] * power(width) + h[:, 1::2]
                width *= 2
            hashes[s] = evened(mixed(h[:, 0]))
        by = np.argsort(hashes)
        ascending = hashes[by]
        # Slices of one named string stay together.
        edges = np.searchsorted(ascending, ascending[SLICES::SLICES], "left")
        r, lo, hi = [], [], []
        for some in np.split(by, np.unique(edges)):
            if len(some):
                gone = windows_to_remove(hashes[some], order[some], size[some], rows_of(text, start[some], size[some], LONGEST))
                edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                at, first = np.nonzero(edge == 1)
                r.append(some[at])
                lo.append(first.astype(np.uint8))
                hi.append((np.nonzero(edge == -1)[1] - 1 + LENGTH).astype(np.uint8))
        r, lo, hi = map(np.concatenate, (r, lo, hi))
        by = np.argsort(r, kind="stable")
        r, lo, hi = r[by], lo[by], hi[by]
        cuts = np.cumsum([0] + [len(p[1]) for p in parts])
        out = []
        for k, p in enumerate(parts):
            s = slice(*np.searchsorted(r, cuts[k:k + 2]))
            out.append(packed((r[s] - cuts[k] + p[0][0]).astype(np.int32), lo[s], hi[s]))
        return pd.DataFrame({"kind": 2, "block": frame["block"], "payload": out})

    return state.groupBy("kind", "at").applyInPandas(answered, "kind int, block long, payload binary")


def remove(blocks: DataFrame, replies: DataFrame, texts_out: bool) -> DataFrame:
    def removed(key, frame: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        out = []
        own, others = reply["payload"][reply["kind"] == 1], reply["payload"][reply["kind"] == 2]
        for payload in frame["payload"]:
            ids, _, sizes, texts = unblocked(payload)
            delta = np.zeros(len(texts) + 1, np.int32)
            for places in own:
                begin, size, head, later = unpacked(places, np.int32, np.uint8, np.bool_, np.bool_)
                begin = begin.astype(np.int64)
                np.add.at(delta, begin[later], 1)
                np.add.at(delta, begin[later] + size[later], -1)
                # Numbers of the slices that no smaller document of the block holds.
                number, begin = np.cumsum(head)[~later] - 1, begin[~later]
                got = [unpacked(p, np.int32, np.uint8, np.uint8) for p in others]
                which, lo, hi = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(3))
                by = np.argsort(which, kind="stable")
                which, lo, hi = which[by], lo[by], hi[by]
                a, b = np.searchsorted(which, number, "left"), np.searchsorted(which, number, "right")
                at = ranges(a, b - a)
                base = np.repeat(begin, b - a)
                np.add.at(delta, base + lo[at], 1)
                np.add.at(delta, base + hi[at], -1)
            gone = np.cumsum(delta[:-1]) > 0
            ends = np.cumsum(sizes)
            for k, (e, s) in enumerate(zip(ends, sizes, strict=True)):
                raw, left = texts[e - s:e], ~gone[e - s:e]
                out.append((ids[k], *ends_of(raw.tobytes(), gone[e - s:e]), raw[left].tobytes() if texts_out else None))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(removed, RESULT)


def blocked_texts(rows: DataFrame) -> DataFrame:
    """Rows (block, payload) of whole texts."""
    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, block in text_blocks(frames):
            sizes = np.array([len(r) for r in block["raw"]], np.int64)
            null = block["doc_id"].isna().to_numpy()
            names = "\n".join("" if x else i for i, x in zip(block["doc_id"], null, strict=True))
            yield pd.DataFrame({"block": [number], "payload": [packed(
                np.frombuffer(names.encode(), np.uint8), null, block["place"].fillna("").map(lambda x: int(x) if x else LAST).to_numpy(np.int64), sizes,
                np.frombuffer(b"".join(block["raw"]), np.uint8))]})

    return rows.mapInPandas(local, "block long, payload binary")


def unblocked(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    names, null, order, sizes, texts = unpacked(payload, np.uint8, np.bool_, np.int64, np.int64, np.uint8)
    ids = [None if x else i for i, x in zip(names.tobytes().decode().split("\n"), null, strict=True)]
    return ids, order, sizes, texts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes if ``texts_out``).

    Ids are whole numbers; a null id counts as larger than all others, and rows of equal id take
    nothing from each other. A null text counts as empty; texts of fewer than LENGTH bytes stay whole.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(id_col).cast("long").cast("string").alias("place"), text_of(text_col).cast("binary").alias("raw"))
    kind = docs.select(F.col(id_col).alias("i")).schema["i"].dataType.simpleString()
    total = rows.select(F.sum(F.length("raw")).alias("n")).first()["n"] or 0
    parts = int(max(8, total / BLOCK_BYTES / BLOCKS_PER_RANGE))
    # So many bits that two of the named hashes agree by chance in about one of a thousand cases.
    bits = int(min(64, max(40, total.bit_length() + 10)))
    # Three steps read the exchange of the blocks; nothing of the texts is sent again but the distinct shared slices, once.
    blocks = blocked_texts(rows)
    replies = answer_slices(cut_slices(blocks, named_in_two(blocks, parts, bits), parts))
    return unkeyed(remove(blocks, replies, texts_out), kind)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
