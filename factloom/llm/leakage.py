"""Held-out passages inside a training corpus, by suffix arrays of its shards."""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A verbatim stretch tells by itself from SHORT letters in scripts without word spaces and from LONG letters elsewhere; half
#: as many do among others, see ``held``.
SHORT, LONG = 8, 16
SHARD_CHARS = 1_000_000
#: Letters changed between two stretches are a light alteration up to so many.
SLACK = 12
#: A shard whose suffixes and documents meet in more pairs is searched in halves of its documents; one document meets a suffix
#: once, and its places are looked at in blocks of so many.
MAX_PAIRS = 4_000_000
MATCHES = "doc_id long, item_id long, covered long, item_chars long, longest long, doc_start long, doc_end long"


def folded(c: str) -> list[int]:
    """What a character stands for in a comparison, as UTF-16 units: its letters and digits without marks, cases and
    compatibility forms; nothing for punctuation and white space."""
    base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    kept = "".join(x for x in unicodedata.normalize("NFKC", base).lower() if x.isalnum())
    return np.frombuffer(kept.encode("utf-16-le"), np.uint16).tolist()


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane the one unit it stands for, or 0; and whether it stands for several."""
    table, several = np.zeros(0x10000, np.uint16), np.zeros(0x10000, bool)
    for c in range(0x10000):
        units = folded(chr(c)) if not 0xD800 <= c < 0xE000 else []
        several[c] = len(units) > 1
        table[c] = units[0] if len(units) == 1 else 0
    return table, several


LETTERS, SEVERAL = _letters()
#: Letters of scripts that write no spaces between words; those beyond the basic plane are nearly all Chinese.
UNSPACED = np.zeros(0x10000, bool)
for _a, _b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xD800, 0xDFFF), (0xF900, 0xFAFF)):
    UNSPACED[_a:_b] = True


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, text number, place in its text) of all texts, each text followed by a 0."""
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    small = np.minimum(raw, 0xFFFF)
    code, at = LETTERS[small], np.arange(len(raw))
    rare = (raw > 0xFFFF) | SEVERAL[small]
    if rare.any():
        # Each of the rare characters stands for as many units as it has.
        kinds, which = np.unique(raw[rare], return_inverse=True)
        units = [folded(chr(c)) for c in kinds.tolist()]
        n = np.ones(len(raw), np.int64)
        n[rare] = np.array([len(u) for u in units])[which]
        at = np.repeat(at, n)
        code, few = code[at], rare[at]
        code[few] = np.concatenate([np.array(units[k], np.uint16) for k in which.tolist()])
    end = np.zeros(len(raw), bool)
    end[starts[1:] - 1] = True
    keep = (code > 0) | end[at]
    at, code = at[keep], code[keep]
    number = np.searchsorted(starts, at, "right") - 1
    return code, number, at - starts[number]


def _key4(code: np.ndarray) -> np.ndarray:
    p = np.concatenate((code, np.zeros(3, np.uint16))).astype(np.uint64)
    n = len(code)
    return (p[:n] << np.uint64(48)) | (p[1 : n + 1] << np.uint64(32)) | (p[2 : n + 2] << np.uint64(16)) | p[3 : n + 3]


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] numbers, then those of begin[1], and so on."""
    return np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _on(value: np.ndarray, at: np.ndarray, beyond: int) -> np.ndarray:
    """The values at some places, ``beyond`` for those behind the end."""
    return np.where(at < len(value), value[np.minimum(at, len(value) - 1)], np.uint32(beyond))


class SuffixArray:
    """All suffixes of a shard in order, by doubling the depth of the sort keys until no two are equal.

    order: places of the suffixes in order. values: for each depth 4, 8, 16 and so on, every place's 2 * b + 2, where b is
    where the suffixes with the same letters up to that depth begin in the order.
    """

    def __init__(self, code: np.ndarray):
        depth, key = 4, _key4(code)
        order = np.argsort(key, kind="stable")
        self.code, self.order, self.first, self.depths, self.values = code, order, key[order], [], []
        equal, key, value = np.arange(len(code)), self.first, np.empty(len(code), np.uint32)
        while True:
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            begin = np.maximum.accumulate(np.where(fresh, equal, 0))
            value = value.copy()
            value[order[equal]] = 2 * begin + 2
            self.depths.append(depth)
            self.values.append(value)
            # Only suffixes that have an equal are sorted anew, each among its equals.
            several = ~(fresh & np.append(fresh[1:], True))
            equal, begin = equal[several], begin[several]
            if not len(equal):
                break
            key = (begin.astype(np.uint64) << np.uint64(32)) | _on(value, order[equal] + depth, 0).astype(np.uint64)
            inner = np.argsort(key, kind="stable")
            order[equal], key = order[equal[inner]], key[inner]
            depth *= 2

    def _bisect(self, k: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
        """In each interval of suffixes equal to depth k, the first of which the letters beyond it do not come before those wanted,
        or, on the right, the first of which they come after them."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            there = _on(self.values[k], self.order[mid] + self.depths[k], 0)
            before = there <= wanted[open_] if right else there < wanted[open_]
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
            open_ = open_[low[open_] < high[open_]]
        return low

    def search(self, code: np.ndarray, starts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Every suffix of ``code`` sought by binary search, to each depth in turn as long as the shard has it.

        Gives for each depth (low, high), where the suffixes with the same letters up to it lie in the order (low = high: none);
        where each suffix would stand in the order; and for each depth which suffixes the shard has, with their values. starts:
        the distinct first four letters of the suffixes, in order, and which of them each has; they are sought once each.
        """
        key, which = starts or np.unique(_key4(code), return_inverse=True)
        bounds, values, live = {}, [], np.arange(len(code))
        low, high = np.searchsorted(self.first, key, "left")[which], np.searchsorted(self.first, key, "right")[which]
        value = np.empty(len(code), np.uint32)
        for k, depth in enumerate(self.depths):
            if k:
                wanted = _on(value, live + self.depths[k - 1], 1)
                a = self._bisect(k - 1, low[live], high[live], wanted, False)
                b = self._bisect(k - 1, a, high[live], wanted, True)
                # Those that ended before keep their place, as equals begin where they did.
                low, high, value = low.copy(), low.copy(), value.copy()
                low[live], high[live] = a, b
            a, b = low[live], high[live]
            bounds[depth] = (low, high)
            value[live] = np.where(a < b, 2 * a + 2, 2 * a + 1)
            live = live[a < b]
            values.append((live, value[live]))
        return bounds, low, values

    def common(self, theirs: np.ndarray, values: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How many letters the suffixes q of ``theirs`` and p of the shard have in common."""
        n = np.zeros(len(q), np.int64)

        def advance(k: int, rest: np.ndarray) -> np.ndarray:
            (live, value), a, b = values[k], q[rest] + n[rest], p[rest] + n[rest]
            if not len(live):
                return rest[:0]
            at = np.minimum(np.searchsorted(live, a), len(live) - 1)
            same = rest[(live[at] == a) & (value[at] == _on(self.values[k], b, 0))]
            n[same] += self.depths[k]
            return same

        rest = every = np.arange(len(q))
        while len(rest):
            rest = advance(-1, rest)
        for k in range(len(self.depths) - 2, -1, -1):
            advance(k, every)
        rest = every
        for _ in range(3):
            a, b = q[rest] + n[rest], p[rest] + n[rest]
            ok = (a < len(theirs)) & (b < len(self.code))
            rest = rest[ok][theirs[a[ok]] == self.code[b[ok]]]
            n[rest] += 1
        return n


class Items:
    """Held-out texts without their stock prompts, as letters."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.texts = texts
        self.ids = np.array(ids, np.int64)
        self.code, self.number, _ = letters(texts)
        self.size = np.bincount(self.number[self.code > 0], minlength=len(texts))
        dense = np.bincount(self.number[self.code > 0], UNSPACED[self.code[self.code > 0]], minlength=len(texts))
        self.depth = np.where(dense * 2 > self.size, SHORT, LONG)
        self.starts = np.unique(_key4(self.code), return_inverse=True)
        # A suffix that runs past the end of its item would compare beyond it.
        last = np.flatnonzero(self.code == 0)
        self.left = last[self.number] - np.arange(len(self.code))
        self.start = np.concatenate(([0], last[:-1] + 1)) if len(last) else np.zeros(0, np.int64)


def _covered(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``size`` letters lie in any of the stretches [a, b)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge)[:-1] > 0


def _runs(q: np.ndarray, p: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (q, p, length) that follow each other or overlap on one diagonal, each joined to one."""
    order = np.lexsort((q, p - q))
    q, p, length = q[order], p[order], length[order]
    if not len(q):
        return q, p, length
    fresh = np.concatenate(([True], (np.diff(p - q) != 0) | (q[1:] > q[:-1] + length[:-1])))
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(q)) - 1
    return q[head], p[head], q[tail] + length[tail] - q[head]


def _supported(run: int, p: np.ndarray, diagonal: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches about each one, on like diagonals and not far in the document, have 2 * run letters together: a copy
    keeps its order between alterations, and a short stretch alone is chance."""
    x, y = diagonal // SLACK, p // (8 * run)
    wide = np.int64(y.max() + 3)
    cells, which = np.unique((x - x.min() + 1) * wide + y + 1, return_inverse=True)
    total = np.bincount(which, length)
    near = np.zeros(len(cells))
    for step in (i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1)):
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        near += np.where(cells[at] == cells + step, total[at], 0)
    return near[which] >= 2 * run


def passages(run: int, q: np.ndarray, p: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, p, length, head): an item's and a document's stretches that count, by passage, given all maximal ones of at least ``run``
    letters; head: where each passage begins.

    q, p, length: where a stretch begins in item and document. One of 2 * run letters counts by itself, a shorter one among
    others in the same order. A passage of the document is where such stretches lie at most 4 * run letters apart.
    """
    if len(p):
        long = _supported(run, p, p - q, length)
        q, p, length = q[long], p[long], length[long]
    order = np.argsort(p, kind="stable")
    q, p, length = q[order], p[order], length[order]
    if not len(p):
        return q, p, length, order
    reach = np.maximum.accumulate(p + length)
    return q, p, length, np.flatnonzero(np.concatenate(([True], p[1:] > reach[:-1] + 4 * run)))


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the disjoint stretches that [a, b) make up."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return a[head], b[np.append(head[1:], len(a)) - 1] - a[head]


class _Contest:
    """The items of one document, given the letters of the document that each covers, as disjoint stretches."""

    def __init__(self, unions: list[tuple[np.ndarray, np.ndarray]]):
        begin, length = (np.concatenate(x) for x in zip(*unions))
        owner = np.repeat(np.arange(len(unions)), [len(u[0]) for u in unions])
        order = np.argsort(begin, kind="stable")
        self.begin, self.end, self.owner = begin[order], (begin + length)[order], owner[order]
        self.reach = np.maximum.accumulate(self.end)

    def won(self, item: int, lo: int, hi: int) -> bool:
        """Whether no other item covers more of [lo, hi). Only what overlaps it is looked at."""
        near = slice(np.searchsorted(self.reach, lo, "right"), np.searchsorted(self.begin, hi, "left"))
        n = np.maximum(np.minimum(self.end[near], hi) - np.maximum(self.begin[near], lo), 0)
        items, which = np.unique(self.owner[near], return_inverse=True)
        covers = np.bincount(which, n)
        return covers[np.searchsorted(items, item)] == covers.max()


def _changed(q: np.ndarray, p: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What was changed between neighbouring stretches of a passage: the item's letters [a, b) where both texts have at most SLACK
    letters, or the document SLACK more."""
    end, after = (q + length)[:-1], (p + length)[:-1]
    gap, there = q[1:] - end, p[1:] - after
    near = (gap > 0) & (gap <= SLACK) & (there >= 0) & (there <= gap + SLACK)
    return end[near], q[1:][near]


def held(size: int, item: int, found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], contest: _Contest) -> np.ndarray:
    """Which of an item's letters a document holds: those in the stretches of its passages, and those changed between two of them. A
    passage of which another item covers more does not count.

    Of passages that hold the same letters one is enough, so a phrase that stands in very many places is looked at until one of
    them counts; the longest passages come first, and those that could add nothing are left out.
    """
    q, p, length, head = found
    tail, out = np.append(head[1:], len(q)), np.zeros(size, bool)
    first, last, total = np.minimum.reduceat(q, head), np.maximum.reduceat(q + length, head), np.add.reduceat(length, head)
    lo, hi = p[head], np.maximum.reduceat(p + length, head)
    shape = np.add.reduceat((p - np.repeat(lo, tail - head)) * (length + 1) + q * length, head)
    kinds, which = np.unique(np.stack((-total, first, last, shape)), axis=1, return_inverse=True)
    places = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[places], np.arange(kinds.shape[1] + 1))
    for k in range(kinds.shape[1]):
        if out[kinds[1, k] : kinds[2, k]].all():
            continue
        for at in places[begins[k] : begins[k + 1]].tolist():
            if contest.won(item, int(lo[at]), int(hi[at])):
                part = slice(head[at], tail[at])
                a, b = _changed(q[part], p[part], length[part])
                out |= _covered(size, np.append(q[part], a), np.append((q + length)[part], b))
                break
    return out


class _Shard:
    """A shard's suffix array, and in it each suffix of the items."""

    def __init__(self, items: Items, texts: list[str]):
        self.items = items
        code, self.number, self.place = letters(texts)
        self.array = SuffixArray(code)
        self.bounds, self.stand, self.values = self.array.search(items.code, items.starts)
        # Suffixes of one document in their order: those of an interval of the order that lie in it are a run here.
        order = self.array.order
        self.n = np.int64(len(order))
        self.by_doc = np.sort(self.number[order].astype(np.int64) * self.n + np.arange(self.n))

    def meetings(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(suffix, document) for every suffix of an item of which a document has as many letters as a short stretch; None where
        there are too many and the documents can be parted."""
        found, total = [], 0
        for run in (SHORT // 2, LONG // 2):
            if run not in self.bounds:
                continue
            low, high = self.bounds[run]
            q = np.flatnonzero((low < high) & (self.items.depth[self.items.number] == 2 * run) & (self.items.left >= run))
            if not len(q):
                continue
            # The documents of each interval that is met, once each.
            begins, which = np.unique(low[q], return_inverse=True)
            n = high[q][np.unique(which, return_index=True)[1]] - begins
            docs = self.number[self.array.order[_ranges(begins, n)]].astype(np.int64)
            once = np.unique(np.repeat(np.arange(len(begins)), n) * (self.number[-1] + 1) + docs)
            group, docs = np.divmod(once, self.number[-1] + 1)
            first = np.searchsorted(group, np.arange(len(begins) + 1))
            count = (first[1:] - first[:-1])[which]
            total += count.sum()
            if total > MAX_PAIRS and self.number[-1] > 0:
                return None
            found.append((np.repeat(q, count), docs[_ranges(first[which], count)]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)

    def longest(self, q: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest stretch with which each suffix begins in its document: that of a neighbour, among the
        document's suffixes, of where it would stand."""
        at = np.searchsorted(self.by_doc, doc * self.n + self.stand[q])
        best, where = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for side in (at, at - 1):
            inside = (side >= 0) & (side < self.n)
            d, i = np.divmod(self.by_doc[np.clip(side, 0, self.n - 1)], self.n)
            k = np.flatnonzero(inside & (d == doc))
            n = np.minimum(self.array.common(self.items.code, self.values, q[k], self.array.order[i[k]]), self.items.left[q[k]])
            better = n > best[k]
            best[k[better]], where[k[better]] = n[better], self.array.order[i[k]][better]
        return best, where

    def stretches(self, q: np.ndarray, doc: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All maximal stretches (q, p, length) of at least ``run`` letters that an item's suffixes q share with a document."""
        low, high = self.bounds[run]
        begin, end = np.searchsorted(self.by_doc, doc * self.n + low[q]), np.searchsorted(self.by_doc, doc * self.n + high[q])
        n, done = end - begin, (np.zeros(0, np.int64),) * 3
        block = np.cumsum(n) // MAX_PAIRS
        for k in np.unique(block).tolist():
            part = block == k
            p = self.array.order[self.by_doc[_ranges(begin[part], n[part])] % self.n]
            more = (np.repeat(q[part], n[part]), p, np.full(len(p), run, np.int64))
            done = _runs(*(np.concatenate(x) for x in zip(done, _runs(*more))))
        return done


def leaks(items: Items, docs: np.ndarray, texts: list[str], share: float) -> list[tuple]:
    """(document, item, covered, item's letters, longest, its first and last place) of each leak in one shard."""
    if not len(items.ids) or not any(texts):
        return []
    shard = _Shard(items, texts)
    met = shard.meetings()
    if met is None:
        k = len(texts) // 2
        return leaks(items, docs[:k], texts[:k], share) + leaks(items, docs[k:], texts[k:], share)
    q, doc = met
    group = doc * len(items.ids) + items.number[q]
    order = np.lexsort((q, group))
    q, doc, group = q[order], doc[order], group[order]
    if not len(q):
        return []
    # Held letters lie in stretches or were changed between two of them, at most SLACK at a place. So pairs whose stretches are too
    # few for that are none, whatever else is looked at.
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    tail = np.append(head[1:], len(q))
    item = items.number[q[head]]
    run = items.depth[item] // 2
    step = np.concatenate(([0], np.diff(q)))
    step[head] = run
    gap = np.maximum(step - np.repeat(run, tail - head), 0)
    most = np.add.reduceat(step - np.where(gap > SLACK, gap, 0), head)
    possible = np.flatnonzero(most >= share * items.size[item])
    take = _ranges(head[possible], (tail - head)[possible])
    long, where = shard.longest(q[take], doc[take])
    found: dict[int, list] = {}
    at = 0
    for h in possible.tolist():
        mine, k = slice(head[h], tail[h]), int(np.argmax(long[at : at + tail[h] - head[h]]))
        n, place = int(long[at + k]), int(where[at + k])
        at += tail[h] - head[h]
        a, b, c = shard.stretches(q[mine], int(doc[head[h]]), int(run[h]))
        parts = passages(int(run[h]), a - items.start[item[h]], b, c)
        if len(parts[0]):
            found.setdefault(int(doc[head[h]]), []).append((int(item[h]), n, place, parts, _union(parts[1], parts[1] + parts[2])))
    out = []
    for d, pairs in found.items():
        contest = _Contest([x[4] for x in pairs])
        for k, (i, n, place, parts, _) in enumerate(pairs):
            size = int(items.size[i])
            covered = int(held(size, k, parts, contest).sum())
            if covered >= share * size:
                out.append((int(docs[d]), int(items.ids[i]), covered, size, n, int(shard.place[place]), int(shard.place[place + n - 1]) + 1))
    return out


def _search_batches(shared, share: float):
    def run(batches):
        items = Items(*shared.value)
        for batch in batches:
            rows, numbers, texts, size = [], [], [], 0
            for at, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    numbers.append(at)
                    texts.append(text)
                    size += len(text)
                if size >= SHARD_CHARS:
                    rows += leaks(items, np.array(numbers), texts, share)
                    numbers, texts, size = [], [], 0
            if texts:
                rows += leaks(items, np.array(numbers), texts, share)
            names = [f.split()[0] for f in MATCHES.split(", ")]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], names=names)

    return run


def leaked_items(documents: DataFrame, items: DataFrame, *, prompts: tuple[str, ...] = (), share: float = 0.5, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and held-out item of which the document holds at least ``share``, in one or several stretches.

    documents(doc_id long, text); items(item_id long, text). Columns: doc_id, item_id, covered and item_chars (letters of
    the item held and in all), longest (letters of the longest verbatim match) and where that match lies in the document
    (doc_start, doc_end, code points). Texts are compared as letters and digits, with cases, marks and compatibility forms
    folded, an item without the stock prompt it begins with. What counts as held is told at ``passages`` and ``held``: stretches
    from SHORT letters (LONG in scripts with word spaces), ones half as long near others, and what was changed between them, so a
    lightly altered copy keeps its cover. A passage of which another item covers more is that item's copy, in which the two
    share turns of phrase, and does not count. Null and empty texts match nothing, items without letters neither. Repeated
    rows of a document give repeated rows, one without an id a row without it.

    Each batch of documents is cut, between documents, into shards of about SHARD_CHARS characters. A suffix array of the
    shard orders all its suffixes; every suffix of every item is sought in it by binary search, which gives the documents
    that share a short stretch with it, and for each the longest verbatim match and its place. Pairs whose stretches could not
    make up ``share`` go; the others are looked at in full. A document lies in one shard, so nothing is shuffled. Items go to
    the tasks in blocks of at most ``block_chars`` characters, so what is broadcast is bounded whatever their number; each
    block is one more pass, and items of different blocks do not contest passages. Memory is bounded for repetitive texts too: a
    pair is one document and one suffix, not one place.
    """
    sized = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for k in range(blocks):
        block = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else sized
        rows = block.collect()
        texts = [next((r.text[len(p) :] for p in prompts if r.text.startswith(p)), r.text) for r in rows]
        shared = spark.sparkContext.broadcast(([r.item_id for r in rows], texts))
        part = docs.mapInArrow(_search_batches(shared, share), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, leaked: DataFrame) -> DataFrame:
    """The documents that no held-out item leaked into."""
    return documents.join(leaked.select("doc_id").distinct(), "doc_id", "left_anti")
