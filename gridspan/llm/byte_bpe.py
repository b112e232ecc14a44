"""Byte-level BPE by vectorised splitting and cached merging."""

from __future__ import annotations

import base64
import functools
import heapq
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, query, shipped, starts_of, table
from .tokens import default_path

RANKS = "byte_bpe_50k.tiktoken"
BATCH = 1 << 22
ROW = 64

# Classes of code points, and what they become beside their neighbours.
LETTER, NUMBER, BLANK, WHITE, OTHER, QUOTE = range(6)
# Symbols: the classes above, a space or other white space before more white space or the end
# (it goes on with its run), and the first of 1 or 2 letters that end a contraction.
INNER, TAIL1, TAIL2, BREAK = 6, 7, 8, 9
# States: the kind of the slice that is open. JOIN is a slice of one space, which a letter, a
# number or another sign goes on with; APOS1 / APOS2 wait for that many letters of a contraction.
S_CLOSED, S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_RUN, S_APOS1, S_APOS2 = range(8)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, asked from the regular expression library once per worker."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    out[32], out[39] = BLANK, QUOTE
    return out


@functools.lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]``: the next state. ``opens[symbol, state]``: a slice begins here."""
    step, opens = np.zeros((12, 8), np.uint8), np.ones((12, 8), bool)
    for state in range(8):
        for symbol, kind in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER), (QUOTE, S_OTHER)):
            step[symbol, state] = kind
            opens[symbol, state] = state not in (kind, S_JOIN)
        step[BLANK, state] = S_JOIN
        step[WHITE, state] = S_CLOSED
        step[INNER, state] = S_RUN
        opens[INNER, state] = state != S_RUN
        step[BREAK, state] = S_CLOSED
        # a quote before contraction letters opens one only where no slice can go on with it
        for symbol, wait in ((TAIL1, S_APOS1), (TAIL2, S_APOS2)):
            joins = state in (S_OTHER, S_JOIN)
            step[symbol, state] = S_OTHER if joins else wait
            opens[symbol, state] = not joins
    for symbol in (LETTER,):
        step[symbol, S_APOS2], opens[symbol, S_APOS2] = S_APOS1, False
        step[symbol, S_APOS1], opens[symbol, S_APOS1] = S_CLOSED, False
    return step, opens


def boundaries(points: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each code point. ``cut`` marks the separators between texts.

    Splits as ``public_tokenizers.PATTERN`` does: each code point becomes a symbol, each symbol is
    a function from state to state, and functions compose associatively. Rows of code points are
    composed side by side, the rows' functions are scanned, and a second pass reads off states.
    """
    step, opens = _machine()
    n = len(points)
    kind = _classes()[points]
    kind[cut] = BREAK
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], BREAK
    space = (kind == BLANK) | (kind == WHITE)
    space_next = (after == BLANK) | (after == WHITE) | (after == BREAK)
    symbol = kind.copy()
    # \s+(?!\S): all of a run but its last, or all of it at the end of a text
    symbol[space & space_next] = INNER
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        padded = np.concatenate([points[:], np.zeros(2, points.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), "<u4"))
        two = np.zeros(len(quotes), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        symbol[quotes[one]], symbol[quotes[two]] = TAIL1, TAIL2

    rows = -(-n // ROW)
    grid = np.full(rows * ROW, BREAK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    flat = step.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = flat[(column.astype(np.intp) << 3)[:, None] + whole]
    state = np.empty(rows, np.uint8)
    now = S_CLOSED
    for i, row in enumerate(whole.tolist()):  # one look-up per row of 64 code points
        state[i] = now
        now = row[now]
    begins = np.empty((ROW, rows), bool)
    open_flat = opens.ravel()
    for j, column in enumerate(grid):
        at = (column.astype(np.intp) << 3) + state
        begins[j] = open_flat[at]
        state = flat[at]
    return begins.T.ravel()[:n]


class ByteBPE:
    """Ranks of a tiktoken file: merging of slices, with a cache of a fixed number of slices."""

    def __init__(self, path: str, limit: int = 600_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        top = max(self.ranks.values()) + 1
        parts = [b""] * top
        for token, rank in self.ranks.items():
            parts[rank] = token
        self.sizes = np.fromiter(map(len, parts), np.int64, top)
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.places = starts_of(self.sizes)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.none = np.int32(top)
        self._pair_table()
        self.cache: dict[str, bytes] = {}
        self.limit = limit

    def _pair_table(self) -> None:
        """Open addressing from a pair of ids to the id of their joined bytes, where there is one."""
        found = [
            (ranks_a << 32 | ranks_b, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (ranks_a := self.ranks.get(token[:i])) is not None and (ranks_b := self.ranks.get(token[i:])) is not None
        ]
        width = 1 << (4 * len(found)).bit_length()
        self.mask = np.uint64(width - 1)
        self.keys, self.values = np.full(width, -1, np.int64), np.full(width, self.none, np.int32)
        left = np.array(found, np.int64).reshape(-1, 2)
        slot = (mix64(left[:, 0].astype(np.uint64)) & self.mask).astype(np.int64)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free, 0]  # of several for one slot the last one stays
            done = self.keys[slot] == left[:, 0]
            self.values[slot[done]] = left[done, 1]
            left, slot = left[~done], (slot[~done] + 1) & (width - 1)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair's joined bytes, or ``none``; negative ids join with nothing."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(len(key), self.none, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        key = key[open_]
        slot = (mix64(key.astype(np.uint64)) & self.mask).astype(np.int64)
        while len(open_):
            there = self.keys[slot]
            hit = there == key
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & np.int64(self.mask)
        return out

    def _merge_short(self, data: list[bytes], width: int) -> list[bytes]:
        """The merges of many slices of at most ``width`` bytes in step: one merge each a round."""
        n = len(data)
        raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, data), np.int64, n)
        place = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width] = np.where(place < size[:, None], self.single[raw], -1)
        rank = np.full((n, width + 1), self.none, np.int32)
        rank[:, :width] = self._joined(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        live = np.arange(n)
        columns = np.arange(width + 1)
        while len(live):
            now, pairs = ids[live], rank[live]
            at = pairs.argmin(1)
            row = np.arange(len(live))
            best = pairs[row, at]
            go = best != self.none
            live, now, pairs, at, best = live[go], now[go], pairs[go], at[go], best[go]
            if not len(live):
                break
            row = np.arange(len(live))
            # the pair becomes one id and what stands after it moves up
            source = np.minimum(columns + (columns > at[:, None]), width)
            now, pairs = np.take_along_axis(now, source, 1), np.take_along_axis(pairs, source, 1)
            now[row, at] = best
            pairs[row, at] = self._joined(best, now[row, np.minimum(at + 1, width)])
            before = np.flatnonzero(at > 0)
            pairs[before, at[before] - 1] = self._joined(now[before, at[before] - 1], best[before])
            ids[live], rank[live] = now, pairs
        kept = ids >= 0
        flat = ids[kept].tobytes()
        stop = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stop], stop)]

    def _learn(self, slices: set[str]) -> None:
        """Merge the slices that the cache lacks."""
        new = [s for s in slices if s not in self.cache]
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = list(slices)
        by_width: dict[int, list] = {}
        for text in new:
            data = text.encode()
            by_width.setdefault(-(-len(data) // 8) * 8, []).append((text, data))
        for width, group in by_width.items():
            step = max(1, (1 << 18) // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                data = [d for _, d in part]
                merged = self._merge_short(data, width) if width <= 256 else map(self._merge_long, data)
                self.cache.update(zip([t for t, _ in part], merged))

    def _merge_long(self, data: bytes) -> bytes:
        """The same merges by a heap over a linked list: n log n for slices of any length."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return array("i", [ranks[data[i : end[i]]] for i in range(n) if alive[i]]).tobytes()

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, ids per text, and the slices: first code point, text."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        cut = starts_of(sizes + 1) + sizes
        begin = np.flatnonzero(boundaries(points, cut))
        owner = np.searchsorted(cut, begin)
        real = begin != cut[owner]
        begin, owner = begin[real], owner[real]
        local = begin - (cut - sizes)[owner]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        places, slices = local.tolist(), []
        for text, a, b in zip(texts, bounds, bounds[1:]):
            own = places[a:b]
            slices.append([text[x:y] for x, y in zip(own, own[1:] + [len(text)])])
        self._learn(set().union(*slices))
        out = [b"".join(map(self.cache.__getitem__, own)) for own in slices]
        count = np.fromiter(map(len, out), np.int64, len(out)) >> 2
        return np.frombuffer(b"".join(out), "<i4"), count, local, owner

    def decode_many(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes of each text, gathered from the token pool by place and length."""
        size = self.sizes[ids]
        place = np.repeat(self.places[ids] - starts_of(size), size) + np.arange(int(size.sum()))
        data = self.pool[place].tobytes()
        stop = np.cumsum(size)
        ends = np.concatenate([[0], stop])[np.cumsum(count)].tolist() if len(count) else []
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def _groups(texts: list[str], limit: int):
    """Runs of texts of about ``limit`` code points; a longer text is a run of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, path: str | None = None, decode: bool = True, offsets: bool = False) -> DataFrame:
    """(doc_id, ids[, decoded][, slice_starts]) of every row's whole ``text``.

    ``ids`` are ranks of the file at ``path``; ``decoded`` are the bytes the ids stand for, and
    ``slice_starts`` the code point at which each slice of the text begins. One pass, no shuffle.

    A null or empty text has no ids and decodes to no bytes; a null id stays null; repeated rows stay
    repeated; a text of any length is encoded whole (memory is in proportion to the longest text);
    an empty table gives no rows; extra columns are not read.
    """
    path = path or default_path(RANKS)
    schema = "doc_id long, ids array<int>" + ", decoded binary" * decode + ", slice_starts array<int>" * offsets

    def run(batches):
        import pyarrow as pa

        bpe = byte_bpe(path)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in _groups(texts, BATCH):
                ids, count, begin, owner = bpe.encode_many(texts[first:last])
                bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                columns = [keys.slice(first, last - first), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))]
                if decode:
                    columns.append(pa.array(bpe.decode_many(ids, count), pa.binary()))
                if offsets:
                    each = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=last - first))]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(each), pa.array(begin.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"] + ["decoded"] * decode + ["slice_starts"] * offsets)

    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    coded = encode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
