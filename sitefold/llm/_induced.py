"""External induced suffix sorting with capped common-prefix values (numpy, inside one task).

Suffixes are sorted as in induced sorting: positions after which the text first rises (LMS) are sorted by recursion on
their named substrings, and their order induces that of all others in two scans. The tuples of a scan, a position and the
length it has in common with the tuple before it, are in a priority queue: as the number of suffixes of each first
character is known, every tuple has a slot, and the slots of a character fill up in the order in which they are pushed.
A scan reads the slots in runs: as far as they are filled, and no farther than the least slot that the run itself pushes
to. Names of a recursion are characters like any other, so every level is induced, whatever the number of names. The
common-prefix value of a pushed tuple is one more than the least value between its source and the source before; those of
the LMS suffixes come from the recursion: so many names in common are so many characters, to which comes what the first
unlike substrings have in common.

All arrays that are as long as the text (text, types, names, queues) live in a :class:`Store`. It keeps a bounded number of
bytes in memory and the rest in temporary files that end with the task; scans, pushes and comparisons take blocks of at
most ``BLOCK`` entries. So a shard may be far larger than memory.

Common-prefix values are capped at ``cap``; order and values are exact up to that many characters.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries of one block of a scan; entries that a run of a scan tries at least.
BLOCK, LEAST = 1 << 18, 1024


class Store:
    """Arrays in memory up to ``budget`` bytes, and in unnamed temporary files beyond."""

    def __init__(self, budget: int):
        self.left, self.on_disk = budget, 0

    def array(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.zeros(n, kind)
        self.on_disk += size
        file = tempfile.TemporaryFile()
        file.truncate(size)
        return np.asarray(np.memmap(file, kind, "r+", shape=(n,)))  # as a plain array, whose slices cost less

    def release(self, *arrays: np.ndarray) -> None:
        """Give back the room of arrays that were in memory and are not used any more."""
        self.left += sum(a.nbytes for a in arrays if a.base is None)  # mapped files are views


def blocks(n: int) -> Iterator[slice]:
    for k in range(0, n, BLOCK):
        yield slice(k, min(k + BLOCK, n))


def common(text: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many characters the suffixes ``p`` and ``q`` have in common, at most ``most`` and up to the end of the text."""
    limit = np.minimum(np.minimum(len(text) - p, len(text) - q), most)
    out = np.zeros(len(p), np.int64)
    row, k = np.flatnonzero(limit > 0), 0
    while len(row):
        same = text[p[row] + k] == text[q[row] + k]
        k += 1
        row = row[same]
        out[row] = k
        row = row[limit[row] > k]
    return out


def rising(text: np.ndarray, store: Store) -> np.ndarray:
    """Whether each suffix is S-type, that is smaller than the next one; the end of the text is smaller than any character."""
    n = len(text)
    out = store.array(n, bool)
    after, after_rises = None, False
    for part in reversed(list(blocks(n))):
        here = np.asarray(text[part])
        step = np.zeros(len(here), np.int8)
        step[:-1] = (here[1:] > here[:-1]).astype(np.int8) - (here[1:] < here[:-1])
        if after is None:
            step[-1] = -1
        else:
            step[-1] = int(after > here[-1]) - int(after < here[-1]) or (1 if after_rises else -1)
        known = np.where(step != 0, np.arange(len(here)), len(here))
        rises = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
        out[part] = rises
        after, after_rises = here[0], bool(rises[0])
    return out


def lms_positions(rises: np.ndarray, store: Store) -> np.ndarray:
    """S-type positions whose predecessor is L-type."""
    found, n = [], 0
    for part in blocks(len(rises)):
        before = np.r_[True if part.start == 0 else rises[part.start - 1], rises[part][:-1]]
        at = np.flatnonzero(rises[part] & ~before) + part.start
        n += len(at)
        kept = store.array(len(at), np.int64)
        kept[:] = at
        found.append(kept)
    out = store.array(n, np.int64)
    n = 0
    for kept in found:
        out[n : n + len(kept)] = kept
        n += len(kept)
        store.release(kept)
    return out


def counts_of(text: np.ndarray, characters: int, rises: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many L- and S-type suffixes begin with each character."""
    falling, rising_ = np.zeros(characters, np.int64), np.zeros(characters, np.int64)
    for part in blocks(len(text)):
        chars, up = np.asarray(text[part]), np.asarray(rises[part])
        falling += np.bincount(chars[~up], minlength=characters)
        rising_ += np.bincount(chars[up], minlength=characters)
    return falling, rising_


class Queue:
    """Tuples (position, common prefix) by slot. ``seams``: slots whose tuple follows one of the other type."""

    def __init__(self, text: np.ndarray, rises: np.ndarray, size: int, heads: np.ndarray, cap: int, store: Store, with_lcp: bool):
        self.text, self.rises, self.cap, self.store, self.with_lcp = text, rises, cap, store, with_lcp
        self.pos = store.array(size, np.int64)
        for part in blocks(size):
            self.pos[part] = -1
        self.lcp = store.array(size if with_lcp else 0, np.uint8)
        self.head, self.first = heads.copy(), heads
        # for each character the least value after its last push within that run of slots, and which run it was; for each
        # value the last run that holds no more: so what is least since a push is looked up, and not kept up for all characters
        self.rest, self.run_of = (store.array(len(heads) if with_lcp else 0, t) for t in (np.uint8, np.int32))
        self.runs, self.last_run = 1, np.zeros(256, np.int64)
        self.seams, self.seam_at = np.zeros(0, np.int64), 0
        self.short_seams = False

    def seam(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What L- and S-type suffixes of one first character have in common: the shorter run of it."""
        if self.short_seams:
            return np.ones(len(p), np.uint8)

        def run(at: np.ndarray) -> np.ndarray:
            out, row = np.ones(len(at), np.int64), np.arange(len(at))
            for k in range(1, self.cap):
                row = row[at[row] + k < len(self.text)]
                row = row[self.text[at[row] + k] == self.text[at[row]]]
                if not len(row):
                    break
                out[row] = k + 1
            return out

        return np.minimum(np.minimum(run(p), run(q)), self.cap).astype(np.uint8)

    def scan(self, up: bool) -> None:
        """Read all slots in order; each tuple pushes the suffix that starts one character earlier, if that is S-type (``up``)
        or L-type."""
        slots, text, rises, head, with_lcp = self.pos, self.text, self.rises, self.head, self.with_lcp
        s, size, width = 0, len(slots), LEAST
        while s < size:
            pos = slots[s : s + width]
            if pos.min() < 0:
                pos = pos[: int((pos < 0).argmax())]
            end = len(pos)
            before = pos - 1
            at = ((rises[before] == up) & (pos > 0)).nonzero()[0]  # -1 is the last position, and left out
            n = len(at)
            if n:
                chars = text[before[at]]
                least = int(head[chars].min()) - s
                if least < end:
                    end = least
                    n = int(at.searchsorted(end))
                    at, chars, pos = at[:n], chars[:n], pos[:end]
            # a run that had to stop early is tried shorter the next time
            width = min(2 * width, BLOCK) if end == width else max(2 * end, LEAST)
            if n:
                order = chars.argsort(kind="stable")
                at, chars = at[order], chars[order]
                new = np.empty(n, bool)
                new[0] = True
                np.not_equal(chars[1:], chars[:-1], out=new[1:])
                cut = new.nonzero()[0]
                there = chars[cut]
                many = np.empty(len(cut), np.int64)
                many[:-1] = cut[1:]
                many[-1] = n
                many -= cut
                slot = (head[there] - cut).repeat(many) + np.arange(n)
                slots[slot] = before[at]
                if with_lcp:
                    self.push_lcp(s, pos, at, there, cut, slot)
                head[there] += many
            elif with_lcp:
                self.last_run[int(self.settled(s, pos).min()) :] = self.runs
                self.runs += 1
            s += end

    def settled(self, s: int, pos: np.ndarray) -> np.ndarray:
        """The common prefixes of a run of slots, with those of its seams."""
        lcp = self.lcp[s : s + len(pos)]
        low = self.seam_at
        while self.seam_at < len(self.seams) and self.seams[self.seam_at] < s + len(pos):
            self.seam_at += 1
        if low < self.seam_at:
            there = self.seams[low : self.seam_at]
            lcp[there - s] = self.seam(pos[there - s], self.pos[there - 1])
        return lcp

    def push_lcp(self, s: int, pos: np.ndarray, at: np.ndarray, there: np.ndarray, cut: np.ndarray, slot: np.ndarray) -> None:
        """Common prefixes of the tuples that the run of slots from ``s`` pushes: ``at`` are their sources, by character."""
        n = len(pos)
        lcp = np.empty(n + 1, np.uint8)
        lcp[:n] = self.settled(s, pos)
        lcp[n] = 255
        # least values from after the source before up to the source; for the first of a character from the last run on
        span = np.empty(2 * len(at), np.int64)
        span[2::2] = at[:-1] + 1
        span[2 * cut] = at[cut]
        span[1::2] = at + 1
        value = np.minimum.reduceat(lcp, span)[::2]
        since = np.minimum(self.rest[there], self.last_run.searchsorted(self.run_of[there], side="right"))
        value[cut] = np.minimum(np.minimum.accumulate(lcp)[at[cut]], since)
        value = np.minimum(value, self.cap - 1) + np.uint8(1)
        fresh = cut[slot[cut] == self.first[there]]
        value[fresh] = 0  # the first of its character
        self.lcp[slot] = value
        self.last_run[int(lcp.min()) :] = self.runs
        last = np.empty(len(cut), np.int64)
        last[:-1] = cut[1:]
        last[-1] = len(at)
        self.rest[there] = np.minimum.accumulate(lcp[::-1])[::-1][at[last - 1] + 1]
        self.run_of[there] = self.runs
        self.runs += 1


def induced(text: np.ndarray, characters: int, rises: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, cap: int, store: Store, substrings: bool = False) -> Queue:
    """All suffixes from the last to the first, with the common prefix with the one before in this order, induced from the
    LMS suffixes ``seeds`` in order; for ``substrings`` only their first characters are."""
    with_lcp = seed_lcp is not None
    falling, up = counts_of(text, characters, rises)
    of_seeds = np.zeros(characters, np.int64)
    for part in blocks(len(seeds)):
        of_seeds += np.bincount(np.asarray(text[seeds[part]]), minlength=characters)
    heads = np.cumsum(np.r_[0, falling + of_seeds])[:-1]
    lefts = Queue(text, rises, int(falling.sum() + of_seeds.sum()), heads, cap, store, with_lcp)
    lefts.short_seams = substrings
    shift = np.cumsum(falling)  # L-type suffixes up to a character come before its seeds
    for part in blocks(len(seeds)):
        pos = np.asarray(seeds[part])
        slot = np.arange(part.start, part.stop) + shift[text[pos]]
        lefts.pos[slot] = pos
        if with_lcp:
            lefts.lcp[slot] = seed_lcp[part]
    begins = np.flatnonzero(of_seeds > 0)
    if with_lcp:
        lefts.lcp[heads[begins] + falling[begins]] = 0
    lefts.seams = (heads + falling)[(of_seeds > 0) & (falling > 0)]
    last = int(text[-1])
    lefts.pos[heads[last]] = len(text) - 1
    lefts.head[last] += 1
    lefts.scan(False)

    # from the last to the first: for each character its S-type suffixes, then its L-type ones
    before = np.cumsum((falling + up)[::-1])[::-1] - (falling + up)
    out = Queue(text, rises, len(text), before, cap, store, with_lcp)
    for part in blocks(len(lefts.pos)):
        pos = np.asarray(lefts.pos[part])
        chars = np.asarray(text[pos]).astype(np.int64)
        nth = np.arange(part.start, part.stop) - heads[chars]
        mine = nth < falling[chars]
        slot = (before + up + falling - 1)[chars[mine]] - nth[mine]
        out.pos[slot] = pos[mine]
        if with_lcp:
            more = mine & (nth + 1 < falling[chars])
            out.lcp[(before + up + falling - 1)[chars[more]] - nth[more]] = lefts.lcp[np.flatnonzero(more) + part.start + 1]
    out.seams = (before + up)[(up > 0) & (falling > 0)][::-1].copy()
    store.release(lefts.pos, lefts.lcp, lefts.rest, lefts.run_of)
    out.scan(True)
    store.release(out.rest, out.run_of)
    return out


def named(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray, cap: int, store: Store) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, from the LMS positions in the order of their substrings."""
    names = store.array(len(lms), np.int64)
    name, last = -1, np.zeros(0, np.int64)
    for part in blocks(len(ordered)):
        pos = np.r_[last, ordered[part]]
        nth = np.searchsorted(lms, pos)
        end = np.where(nth + 1 < len(lms), lms[np.minimum(nth + 1, len(lms) - 1)] + 1, len(text))
        size = end - pos
        # the last substring ends with the text, and is like no other
        alike = (size[1:] == size[:-1]) & (nth[1:] + 1 < len(lms)) & (nth[:-1] + 1 < len(lms))
        most = np.where(alike, np.minimum(size[1:], cap), 0)
        same = alike & (common(text, pos[1:], pos[:-1], most) == most)
        new = np.cumsum(np.r_[(True,) if not len(last) else (), ~same]) + name
        names[nth[len(last) :]] = new
        name, last = int(new[-1]), pos[-1:]
    return names, name + 1


def sorted_lms(text: np.ndarray, characters: int, rises: np.ndarray, lms: np.ndarray, cap: int, store: Store, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in the order of their suffixes, and the common prefix of each with the one before."""
    n = len(lms)
    by_char, lcp = store.array(n, np.int64), store.array(n, np.uint8)
    if n < 2:
        by_char[:] = lms
        return by_char, lcp
    head = np.zeros(characters, np.int64)
    for part in blocks(n):
        head += np.bincount(np.asarray(text[lms[part]]), minlength=characters)
    head = np.cumsum(np.r_[0, head])[:-1]
    for part in blocks(n):
        chars = np.asarray(text[lms[part]]).astype(np.int64)
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        cut = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
        many = np.diff(np.r_[cut, len(chars)])
        by_char[head[chars] + np.arange(len(chars)) - np.repeat(cut, many)] = np.asarray(lms[part])[order]
        head[chars[cut]] += many
    queue = induced(text, characters, rises, by_char, None, cap, store, substrings=True)
    ordered, k = by_char, n
    for part in blocks(len(queue.pos)):
        pos = np.asarray(queue.pos[part])
        mine = pos[(pos > 0) & rises[pos] & ~rises[np.maximum(pos - 1, 0)]]
        ordered[k - len(mine) : k] = mine[::-1]
        k -= len(mine)
    store.release(queue.pos)
    names, count = named(text, lms, ordered, cap, store)
    if count <= 1 << 16:  # short characters are gathered and sorted faster
        wide, names = names, store.array(n, np.uint16)
        for part in blocks(n):
            names[part] = wide[part]
        store.release(wide)
    if count < n:
        # an LMS substring spans two characters at least
        deeper = sorted_suffixes(names, count, cap // 2 + 2, store, depths)
        for part in blocks(n):  # from the last to the first
            ordered[n - part.stop : n - part.start] = lms[deeper.pos[part]][::-1]
        for part in blocks(n - 1):
            a, b = deeper.pos[part.start + 1 : part.stop + 1], deeper.pos[part]
            lcp[n - part.stop : n - part.start] = carried(text, lms, a, b, deeper.lcp[part.start + 1 : part.stop + 1], cap)[::-1]
        store.release(deeper.pos, deeper.lcp)
    else:
        for part in blocks(n - 1):
            p, q = ordered[part], ordered[part.start + 1 : part.stop + 1]
            lcp[part.start + 1 : part.stop + 1] = common(text, p, q, np.full(len(p), cap))
    store.release(names)
    return ordered, lcp


def carried(text: np.ndarray, lms: np.ndarray, a: np.ndarray, b: np.ndarray, names: np.ndarray, cap: int) -> np.ndarray:
    """The common prefixes of LMS suffixes (numbers ``a`` and ``b``) that have so many ``names`` in common: the characters of
    these names, and what the first unlike substrings have in common."""
    k = names.astype(np.int64)
    last = len(lms) - 1
    one, two = lms[np.minimum(a + k, last)], lms[np.minimum(b + k, last)]
    known = np.minimum(one - lms[a], cap)
    return np.minimum(known + common(text, one, two, cap - known), cap)


def sorted_suffixes(text: np.ndarray, characters: int, cap: int, store: Store, depths: list[int]) -> Queue:
    """All suffixes from the last to the first with their common prefixes; ``depths`` gets the length of each level's text."""
    depths.append(len(text))
    rises = rising(text, store)
    lms = lms_positions(rises, store)
    seeds, lcp = sorted_lms(text, characters, rises, lms, cap, store, depths)
    store.release(lms)
    out = induced(text, characters, rises, seeds, lcp, cap, store)
    store.release(seeds, lcp, rises)
    return out


def suffixes_descending(text: np.ndarray, cap: int, budget: int = 1 << 26, depths: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of a byte text from the last to the first, in blocks of (position, capped common prefix with the
    suffix before in this order). ``cap`` is at most 254; ``text`` may be mapped from a file."""
    if not len(text):
        return
    out = sorted_suffixes(text, 256, cap, Store(budget), [] if depths is None else depths)
    for part in blocks(len(text)):
        yield np.asarray(out.pos[part]), np.asarray(out.lcp[part])
