"""Periodic runs of words, found through minimizers of several scales.

A run is a stretch of consecutive words with smallest period q, at least
``max(least, 2 * q)`` long, that no neighbouring word extends.

*Short periods*, below ``SHORT``, are scanned directly: words that equal the word
q places on, for each such lag q.

*Longer periods* are looked for scale by scale.  The minimizer of a window is its
smallest three-word hash, the leftmost of equal ones.  At width w the periods from
4w to 8w are sought: in a run of such a period the window w wide at its start and
the one q further on hold the same words, so the run has two equal minimizers q
apart.  Equal minimizers at these distances are seeds, and a seed is extended to
both sides as long as words q apart agree.  Seeds inside one run of a period below
w are not formed: they could only show multiples of that period.  Should a text
still have more seeds than its lags of that scale would cost to scan, these lags
are scanned, so every text is treated exactly.

A stretch found with several lags has the smallest of them as its period: by the
theorem of Fine and Wilf a longer lag with the same stretch is its multiple.

Texts are handled in blocks of a few megabytes inside each task; a text is never
split, and no row is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

LEAST = 12               # words of the shortest run
SHORT = 32               # lags below this are scanned directly
GRAM = 3                 # words in one hash
BLOCK_BYTES = 4 << 20    # text handled at a time, or one longer text
PAIR_COST = 32           # a seed costs about as much as so many compared words
FEW_PAIRS = 50_000       # seeds of one text and scale that are formed in any case

ROW = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: (id, number of words) to (first word, period) of a tail that is overwritten, or None.
Rewrite = Callable[[int, int], tuple[int, int] | None]


def _mix(v: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash; wraps around on purpose."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _at_lag(x: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches with period ``q`` that are long enough."""
    same = np.flatnonzero(x[q:] == x[:-q])
    need = max(least - q, q)
    if len(same) < need:
        return same[:0], same[:0]
    breaks = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate(([0], breaks + 1))]
    last = same[np.concatenate((breaks, [len(same) - 1]))]
    long = last - first + 1 >= need
    return first[long], last[long] + 1 + q


def _agree(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the words at ``at`` and ``at + q`` are there and equal."""
    inside = (at >= 0) & (at + q < len(x))
    low = np.where(inside, at, 0)
    return inside & (x[low] == x[np.where(inside, at + q, 0)])


def _extended(x: np.ndarray, m: int, q: int) -> tuple[int, int]:
    """The stretch of agreeing words around ``m``, from and before."""
    start, step = m, 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(x[low:start] != x[low + q:start + q])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, step * 4
    end, step, top = m, 64, len(x) - q
    while end < top:
        high = min(top, end + step)
        differ = np.flatnonzero(x[end:high] != x[end + q:high + q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = high, step * 4
    return start, end


def _from_seeds(x: np.ndarray, m: np.ndarray, q: np.ndarray, w: int, least: int) -> list[tuple[int, int, int]]:
    """Runs around the seeds.  A stretch of 4w agreeing words holds 2w of them to
    the left or to the right of any of its words, so few other seeds are extended."""
    here = _agree(x, m, q)
    right, left = here.copy(), here
    for step in (w // 2, w, 2 * w - 1):
        right &= _agree(x, m + step, q)
        left = left & _agree(x, m - step, q)
    good = right | left
    m, q = m[good], q[good]
    order = np.lexsort((m, q))
    runs, lag, done = [], 0, 0
    for at, period in zip(m[order].tolist(), q[order].tolist()):
        if period == lag and at < done:
            continue
        start, end = _extended(x, at, period)
        lag, done = period, end
        if end - start >= max(period, least - period):
            runs.append((start, end + period, period))
    return runs


def find_runs(x: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs (start, end, period) of the texts ``x[bounds[i]:bounds[i + 1]]``, each
    of which ends in a number found nowhere else."""
    found: list[tuple[int, int, int]] = []
    longest = int(np.diff(bounds).max()) if len(bounds) > 1 else 0
    for q in range(1, min(SHORT, longest // 2 + 1)):
        found += [(s, e, q) for s, e in zip(*(a.tolist() for a in _at_lag(x, q, least)))]
    if longest // 2 >= SHORT:
        found += _longer(x, bounds, longest, least, found)
    runs = np.array(found, np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _longer(x: np.ndarray, bounds: np.ndarray, longest: int, least: int, short: list[tuple[int, int, int]]
            ) -> list[tuple[int, int, int]]:
    h = _mix(x.astype(np.uint64) + np.uint64(1))
    n = len(x) - GRAM + 1
    gram = sum((h[i:n + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15) for i in range(GRAM)), np.zeros(n, np.uint64))
    least_of = (_mix(gram) & np.uint64(0x7FFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    least_of = least_of.view(np.int64)   # hash above, place below: the smallest is the leftmost
    covered = np.arange(len(x), dtype=np.int64)   # first place outside the short-period runs over a place
    waiting, found, w = list(short), [], 1
    while 4 * w <= longest // 2:
        if 4 * w >= SHORT:
            for s, e, p in [r for r in waiting if r[2] < w]:
                inside = covered[s:max(s, e - GRAM + 1)]
                np.maximum(inside, e - GRAM + 1, out=inside)
            waiting = [r for r in waiting if r[2] >= w]
            fresh = np.ones(len(least_of), bool)
            fresh[1:] = least_of[1:] != least_of[:-1]
            runs = _scale(x, bounds, np.sort(least_of[fresh]), covered, w, least)
            found += runs
            waiting += runs
        if len(least_of) <= w:
            break
        least_of = np.minimum(least_of[:-w], least_of[w:])
        w *= 2
    return found


def _scale(x: np.ndarray, bounds: np.ndarray, chosen: np.ndarray, covered: np.ndarray, w: int, least: int
           ) -> list[tuple[int, int, int]]:
    """Runs with periods from 4w to 8w; ``chosen`` are the minimizers by value and place."""
    at = chosen & 0xFFFFFFFF
    text = np.searchsorted(bounds, at, "right") - 1
    low = np.searchsorted(chosen, chosen + np.maximum(4 * w, covered[at] - at))
    high = np.searchsorted(chosen, chosen + np.minimum(8 * w, bounds[text + 1] - at))
    pairs = np.maximum(high - low, 0)
    runs: list[tuple[int, int, int]] = []
    per_text = np.bincount(text, weights=pairs, minlength=len(bounds) - 1)
    dear = (per_text > FEW_PAIRS) & (per_text * PAIR_COST > np.diff(bounds) * 4.0 * w)
    for t in np.flatnonzero(dear).tolist():
        a, b = int(bounds[t]), int(bounds[t + 1])
        for q in range(4 * w, min(8 * w, (b - a) // 2 + 1)):
            runs += [(s + a, e + a, q) for s, e in zip(*(v.tolist() for v in _at_lag(x[a:b], q, least)))]
    pairs[dear[text]] = 0
    ends = np.cumsum(pairs)
    step = max(FEW_PAIRS, 1 << 22)
    cut = 0
    while cut < len(pairs) and ends[-1]:
        base = ends[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(ends, base + step, "right")))
        n = pairs[cut:stop]
        m = np.repeat(at[cut:stop], n)
        other = np.repeat(low[cut:stop], n) + np.arange(len(m)) - np.repeat(np.cumsum(n) - n, n)
        runs += _from_seeds(x, m, at[other] - m, w, least)
        cut = stop
    return runs


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``BLOCK_BYTES`` together, or one row."""
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > BLOCK_BYTES:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def _judged(ids: pa.Array, texts: pa.Array, least: int, rewrite: Rewrite | None) -> pa.RecordBatch:
    split = pc.ascii_split_whitespace(texts)
    flat, parent = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(real).dictionary_encode()
    n = np.bincount(parent.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    if rewrite:
        for i, doc_id in enumerate(ids.to_pylist()):
            tail = rewrite(doc_id, int(n[i])) if doc_id is not None and n[i] else None
            if tail:
                a, p = first[i] + tail[0], tail[1]
                code[a:first[i + 1]] = code[a + np.arange(first[i + 1] - a) % p]
    # One number of its own behind each text keeps stretches inside it.
    bounds = first + np.arange(len(n) + 1)
    place = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
    x = np.empty(len(code) + len(n), np.int64)
    x[place] = code
    x[bounds[1:] - 1] = len(words.dictionary) + np.arange(len(n))
    runs = find_runs(x, bounds, least)

    step = np.zeros(len(x) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    kept = (np.cumsum(step[:-1]) == 0)[place]
    n_kept = np.add.reduceat(np.append(kept, False), first[:-1], dtype=np.int64) * (n > 0) if len(n) else n
    offsets = np.concatenate(([0], np.cumsum(n_kept))).astype(np.int32)
    left = words.dictionary.take(pa.array(code[kept]))
    text = np.searchsorted(bounds, runs[:, 0], "right") - 1
    of_text = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - bounds[text]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
        fields=list(_RUN))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(of_text), spans),
         pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), left), " ")],
        ["doc_id", "n_words", "runs", "kept"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
                  rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs and kept per row of ``docs``, one row each.

    ``runs`` are all runs by start and period, in words from 0; ``kept`` is the text
    less, of each run, what comes after its first period, words joined by a space.
    Null and empty texts have no word, no run and an empty ``kept``.  Repeated rows
    and rows without an id come out like others; other columns are not read.
    ``rewrite`` overwrites the tail of some texts before they are searched (rows
    without an id are left as they are).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in _blocks(sizes):
                yield _judged(ids.slice(a, b - a), pc.fill_null(texts.slice(a, b - a), ""), least, rewrite)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ROW)


def runs_text(runs: str | Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.concat(F.array_join(F.transform(runs, line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def longest(runs: str | Column) -> Column:
    """The run of greatest length, then smallest start and period; null without runs."""
    rank = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    return F.array_max(F.transform(runs, rank))


def planted_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """A ``Rewrite`` that makes the tail of every tenth text periodic, the test tables
    being poor in runs: place and period follow from the id's checksum."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)
