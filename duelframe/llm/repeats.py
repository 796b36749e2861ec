"""Exact repeats across documents by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

1. Every string of that length has a lowest-hash inner string of `_INNER` bytes, its anchor. Neighbouring strings
   mostly share one, which makes runs. Equal strings have equal anchors, so strings whose anchor stands
   in one document only cannot repeat. Anchors are counted into sorted hash arrays, which tasks search.
2. Runs whose anchor repeats are told apart by their text's hash. Within one task and then within one shard of
   anchors, equal runs belong to their smallest document; all others are repeats as a whole. Runs of one text
   are sent on once a task. Runs of an anchor with more than `hot_runs` of them are first cut into their strings,
   each with its own hash in place of the anchor: such strings are dealt by themselves, and step 3 has none of them.
3. Anchors that stand in different texts are where repeats begin or end. A shard joins one text of each kind, sorts
   its suffixes (Larsson-Sadakane), takes common prefixes (Kasai), and strings of equal prefixes belong
   to their smallest document.
4. A document's removed ranges are joined.

Nothing is sampled or capped. The texts are dealt by key once and that exchange serves both joins.

Defined results: null texts count as empty; null ids count as larger than all others; rows of one id do not remove
from one another; repeated rows each keep their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import keyed, mix64, new_folder, saved, slices, width
from duelframe.llm.hash_arrays import FILES, SLICE_BYTES, by_range, collect_ranges, count_rows, file_list, opened, write_file
from duelframe.llm.suffixes import common_prefixes, doubling_suffix_array, merge_sorted

LENGTH = 50
_INNER = 24
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_LAST = (1 << 63) - 1
_SHARD_BYTES = 1 << 20
#: runs take some forty bytes of memory a byte of text
_RUN_SLICE = 2 << 20
#: an anchor of more runs is settled string by string
_HOT_RUNS = 10_000
#: strings of such runs taken together
_HOT_STRINGS = 500_000
#: characters of text whose anchors make one range
_RANGE_CHARS = 32 << 20


def _inner_hashes(raw: bytes, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on, where there are as many."""
    n = len(raw) - size + 1
    if size >= 8:
        words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))  # eight bytes from each place on
        offsets = [*range(0, size - 8, 8), size - 8]
    else:
        words, offsets = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64), [*range(size)]
    total = np.zeros(n, dtype=np.uint64)
    for k, at in enumerate(offsets):
        total += words[at : at + n] * _FACTORS[k % len(_FACTORS)]
    return mix64(total)


def _lowest(values: np.ndarray, window: int) -> np.ndarray:
    """Place of the first lowest value of the `window` values from each place on."""
    best, at, reach = values, np.arange(len(values), dtype=np.int32), 1
    while reach < window:
        step = min(reach, window - reach)
        if len(best) <= step:
            break
        later = best[step:] < best[:-step]
        at = np.where(later, at[step:], at[:-step])
        best = np.where(later, best[step:], best[:-step])
        reach += step
    return at


def runs(raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(document, start, stop, anchor hash) of the runs of strings with one anchor; start and stop within the document."""
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    inner = min(_INNER, length)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if not (sizes >= length).any():
        return empty
    joined = b"".join(raw)
    first = np.cumsum(sizes) - sizes
    values = _inner_hashes(joined, inner)
    anchor = _lowest(values, length - inner + 1)
    # strings that lie within one document
    edge = np.zeros(len(joined) + 1, dtype=np.int32)
    long_enough = sizes >= length
    np.add.at(edge, first[long_enough], 1)
    np.add.at(edge, (first + sizes - length + 1)[long_enough], -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    own = anchor[place]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(place)) - 1
    doc = np.searchsorted(first, place[begin], side="right") - 1
    # empty documents share their place with the next one
    # lowest hashes crowd near zero: mixed again, they spread evenly over ranges
    return doc, place[begin] - first[doc], place[end] + length - first[doc], mix64(values[own[begin]])


def _anchor_documents(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors and 1 where all runs of one are in one document, otherwise the number of its runs."""
    doc, _, _, anchor = runs(raw, length)
    order = np.argsort(anchor)
    anchor, doc = anchor[order], doc[order]
    if not len(anchor):
        return anchor, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
    return anchor[head], np.where(several, np.diff(head, append=len(anchor)), 1)


def _bytes(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def repeated_anchors(texts: DataFrame, length: int, parts: int) -> list[tuple[int, int, int, str]]:
    """Files of the anchors that stand in two documents or more, with about how many runs each has."""
    spark = texts.sparkSession
    folder = new_folder(spark, "anchors")

    def write(batches):
        for p, keys, counts in collect_ranges(batches):
            keys, counts = keys[counts > 1], counts[counts > 1]
            if len(keys):
                yield pa.RecordBatch.from_pydict({"part": [p], "low": [int(keys[:1].view(np.int64)[0])], "n": [len(keys)], "path": [write_file(folder, keys, counts)]})

    counted = texts.select("text").mapInArrow(count_rows(lambda t: _anchor_documents(_bytes(t), length), _RUN_SLICE), "key long, n int")
    return file_list(saved(by_range(counted, parts).mapInArrow(write, FILES), "anchor-files"))


_RUNS = "anchor long, kind long, key long, rank long, start long, stop long"
_WHOLE, _OPEN_RUN, _ASK = 0, 1, 2


def _batch(anchor, kind, key, rank, start, stop) -> pa.RecordBatch:
    columns = (anchor, kind, key, rank, start, stop)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], names=["anchor", "kind", "key", "rank", "start", "stop"])


def _split_classes(anchor, text_hash, rank):
    """Order by anchor, text hash and rank; where classes and anchors begin in it; rank of each row's class head."""
    order = np.lexsort((rank, text_hash, anchor))
    a, h = anchor[order], text_hash[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new_class = new_anchor | np.concatenate([[True], h[1:] != h[:-1]])
    head = np.maximum.accumulate(np.where(new_class, np.arange(len(order)), 0))
    return order, new_anchor, new_class, rank[order][head]


def _settled(anchor, text_hash, key, rank, start, stop):
    """What is left of a slice's runs (two arrays of places), and a batch of the whole repeats found in it."""
    order, _, new_class, head_rank = _split_classes(anchor, text_hash, rank)
    later = rank[order] > head_rank
    whole, first = order[later], order[new_class]
    # of a class's rows with the smallest rank only the first is sent on; the others have nothing smaller here
    same = order[~later & ~new_class]
    passed = _batch(mix64(key[whole].astype(np.uint64)).astype(np.int64) >> 1, np.full(len(whole), -1), key[whole], rank[whole], start[whole], stop[whole])
    return (first, same), passed


def _cut_runs(raw: list[bytes], doc, anchor, key, rank, start, stop, length: int):
    """Runs as single strings: the string's hash in place of the anchor, and the anchor in `kind`."""
    sizes = stop - start - length + 1
    group = np.cumsum(sizes) // _HOT_STRINGS
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        hashes = np.concatenate([_string_hashes(raw[d][a:b], length) for d, a, b in zip(doc[own].tolist(), start[own].tolist(), stop[own].tolist())])
        n = sizes[own]
        begin = np.repeat(start[own], n) + np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
        # equal hashes of different strings would have to come with equal anchors too
        columns = (hashes.astype(np.int64), np.repeat(anchor[own].view(np.uint64) >> np.uint64(1), n).astype(np.int64), np.repeat(key[own], n), np.repeat(rank[own], n), begin, begin + length)
        left, passed = _settled(*columns)
        yield passed
        for some in left:
            yield _batch(*(c[some] for c in columns))


def _dealt_runs(texts: DataFrame, files, length: int, hot_runs: int = _HOT_RUNS) -> DataFrame:
    """Runs with repeated anchors: text hash in `kind` for open ones, whole repeats found within a slice apart."""

    def run(batches):
        for batch in slices(batches, "text", _RUN_SLICE):
            raw = _bytes(batch.column("text").to_pylist())
            doc, start, stop, anchor = runs(raw, length)
            keys, place = np.unique(anchor, return_inverse=True)
            there = opened(files).find(keys)[1] if files else np.zeros(len(keys), dtype=np.int64)
            own = np.flatnonzero(there[place] > 0) if len(keys) else np.zeros(0, np.int64)
            if not len(own):
                continue
            hot = there[place[own]] > hot_runs
            doc, start, stop, anchor = doc[own], start[own], stop[own], anchor[own].astype(np.int64)
            digest = xxhash.xxh3_64_intdigest
            text_hash = np.fromiter((digest(raw[d][s:e]) >> 1 for d, s, e in zip(doc.tolist(), start.tolist(), stop.tolist())), dtype=np.int64, count=len(own))
            key = batch.column("key").to_numpy(zero_copy_only=False)[doc]
            rank = batch.column("rank").to_numpy(zero_copy_only=False)[doc]
            left, passed = _settled(anchor, text_hash, key, rank, start, stop)
            yield passed
            for some in left:
                cold, cut = some[~hot[some]], some[hot[some]]
                yield _batch(anchor[cold], text_hash[cold], key[cold], rank[cold], start[cold], stop[cold])
                if len(cut):
                    yield from _cut_runs(raw, doc[cut], anchor[cut], key[cut], rank[cut], start[cut], stop[cut], length)

    return texts.mapInArrow(run, _RUNS)


def _resolve_classes(batches):
    """A shard's anchors: whole repeats as `_WHOLE` rows, and of anchors with several texts the heads as `_ASK` rows."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        passed = columns[1] < 0
        if passed.any():
            yield _batch(columns[0][passed], np.full(int(passed.sum()), _WHOLE), *(c[passed] for c in columns[2:]))
        held.append([c[~passed] for c in columns])
    if not held:
        return
    anchor, text_hash, key, rank, start, stop = (np.concatenate(x) for x in zip(*held))
    if not len(anchor):
        return
    order, new_anchor, new_class, head_rank = _split_classes(anchor, text_hash, rank)
    whole = order[rank[order] > head_rank]
    yield _batch(anchor[whole], np.full(len(whole), _WHOLE), key[whole], rank[whole], start[whole], stop[whole])
    group = np.cumsum(new_anchor) - 1
    several = np.bincount(group, weights=new_class) > 1
    # every row of the head's rank: rows of one document that have the same text all wait for the answer
    ask = order[(rank[order] == head_rank) & several[group]]
    for a in range(0, len(ask), 100_000):
        some = ask[a : a + 100_000]
        yield _batch(anchor[some], np.full(len(some), _ASK), key[some], rank[some], start[some], stop[some])


def repeated_strings(texts: list[bytes], ranks: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(text, first, last): ranges of starts of the strings that also start in a text of smaller rank.

    One suffix array over all texts, with an end mark of its own after each.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    m = len(texts)
    codes = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8).astype(np.int64) + 1
    stops = np.cumsum(sizes + 1) - 1
    codes[stops] = 0
    order = doubling_suffix_array(codes, int(sizes.max()) + 1, ends=stops)
    codes[stops] = -1 - np.arange(m)  # end marks differ, so no two suffixes are equal
    prefix = common_prefixes(codes, order, length)
    text = np.repeat(np.arange(m), sizes + 1)
    head = prefix < length
    group = np.cumsum(head) - 1
    least = np.minimum.reduceat(ranks[text[order]], np.flatnonzero(head))
    starts = np.sort(order[ranks[text[order]] > least[group]])
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(text[starts]) > 0))
    first, last = np.append(0, cut + 1), np.append(cut, len(starts) - 1)
    begin = np.concatenate([[0], stops[:-1] + 1])
    own = text[starts[first]]
    return list(zip(own.tolist(), (starts[first] - begin[own]).tolist(), (starts[last] - begin[own]).tolist()))


def _compare_texts(length: int):
    """A shard's texts of anchors that stand in several texts: removed ranges.

    The rows come sorted by anchor. Whole anchors are taken together up to `_SHARD_BYTES`; an anchor with
    more text than that is cut into several suffix arrays, whose string lists are merged by binary search.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > _SHARD_BYTES and row[0] != last:
                    yield from _ranges(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 64
                last = row[0]
        if held:
            yield from _ranges(held, length)

    return run


def _ranges(rows: list[tuple], length: int):
    chunks: list[list[tuple]] = [[]]
    size = 0
    for row in rows:
        if size > 2 * _SHARD_BYTES:
            chunks.append([])
            size = 0
        chunks[-1].append(row)
        size += len(row[4])
    out: list[tuple[int, int, int]] = []
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for chunk in chunks:
        ranks = np.array([r[2] for r in chunk], dtype=np.int64)
        texts = [r[4] for r in chunk]
        for t, a, b in repeated_strings(texts, ranks, length):
            out.append((chunk[t][1], chunk[t][3] + a, chunk[t][3] + b + length))
        if len(chunks) > 1:
            seen.append(_least_ranks(texts, ranks, length))
    for k, chunk in enumerate(chunks if len(chunks) > 1 else []):
        out += _merged(chunk, seen, k, length)
    if out:
        key, start, stop = zip(*out)
        yield pa.RecordBatch.from_pydict({"key": list(key), "start": list(start), "stop": list(stop)})


def _string_hashes(text: bytes, length: int) -> np.ndarray:
    return _inner_hashes(text, length)


def _least_ranks(texts: list[bytes], ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings (by hash) of a chunk and the smallest rank of each."""
    every = [_string_hashes(t, length) for t in texts]
    keys, of = np.concatenate(every), np.repeat(ranks, [len(e) for e in every])
    order = np.lexsort((of, keys))
    keys, of = keys[order], of[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys[head], of[head]


def _merged(chunk: list[tuple], seen: list[tuple[np.ndarray, np.ndarray]], own: int, length: int) -> list[tuple[int, int, int]]:
    """Ranges of a chunk whose strings start in a smaller document of another chunk."""
    out = []
    for key, rank, start, text in ((r[1], r[2], r[3], r[4]) for r in chunk):
        hashes = _string_hashes(text, length)
        hit = np.zeros(len(hashes), dtype=bool)
        for k, (keys, least) in enumerate(seen):
            if k != own:
                place, there = merge_sorted(hashes, keys)
                hit |= there & (least[place] < rank)
        out += [(key, start + i, start + i + length) for i in np.flatnonzero(hit).tolist()]
    return out


def _cut_out(batches, length: int):
    """Remaining bytes of each text."""
    for batch in slices(batches, "text", SLICE_BYTES):
        out = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            kept, at, spans, removed = [], 0, 0, 0
            stop = -1
            for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if r[0] > stop:
                    spans += 1
                    kept.append(raw[at : r[0]])
                removed += max(0, r[1] - max(r[0], stop))
                stop = max(stop, r[1])
                at = stop
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
        columns = [pa.array(x) for x in zip(*out)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_runs: int = _HOT_RUNS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (cut characters become marks of replacement)."""
    texts, lengths = keyed(docs, id_col, text_col)
    texts = texts.select("key", F.coalesce("id", F.lit(_LAST)).alias("rank"), "text", "id").where("key is not null")
    parts = max(width(docs.sparkSession), (lengths.agg(F.sum("n_chars")).first()[0] or 0) // _RANGE_CHARS)
    files = repeated_anchors(texts, length, parts)
    dealt = _dealt_runs(texts.select("key", "rank", "text"), files, length, hot_runs).repartition(parts, "anchor")
    found = saved(dealt.mapInArrow(_resolve_classes, _RUNS), "repeat-runs")
    whole = found.where(F.col("kind") == _WHOLE).select("key", "start", "stop")
    asked = found.where(F.col("kind") == _ASK).select("key", "anchor", "rank", "start", "stop")
    piece = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    pieces = asked.join(texts.select("key", "text"), "key").select("anchor", "key", "rank", "start", piece.alias("piece"))
    compared = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor", "rank").mapInArrow(_compare_texts(length), "key long, start long, stop long")
    ranges = whole.union(compared).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = texts.select("key", "id", "text").join(ranges, "key", "left").select("id", "text", "ranges")
    return joined.mapInArrow(lambda b: _cut_out(b, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
