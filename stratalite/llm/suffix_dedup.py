"""Removal of byte strings that repeat across documents, by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes around it also starts in a document with a
smaller id. Suffixes need an order of their first ``length`` bytes only.

1. Texts are packed into compressed chunks. Prefix polynomial hashes give the hash of
   any substring in constant time. The least hashed piece (anchor) of a window of
   ``length`` bytes depends on the window alone, so equal windows have equal anchors;
   neighbouring windows mostly share theirs, and form one occurrence.
2. A chunk sends one entry for each anchor: the hash of the occurrence's context (all
   its windows) if that is the same throughout the chunk, and its least document. In
   the anchor's bucket, entries that agree are one suffix class, settled by the least
   document. Where contexts differ, the suffixes have to be sorted.
3. For those, chunks send the contexts themselves. The suffixes that begin in one place
   beside an anchor are sorted by eight bytes after eight; those that tie go on, unless
   their hashes agree. What is left after whole eights is merge-sorted, two suffixes
   compared by the hashes of halves, quarters, ... of their common extension.
   Neighbours in the order are then verified by their bytes. Anchors with very many contexts (at the edges of a passage
   that much of the corpus holds) send single windows instead, each to a bucket of its
   own hash, so that no bucket grows with them.
4. Each chunk marks its bytes and returns its documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import ship

from .common import text_of, written
from .ngram_join import _mixed, _powers

#: Bytes of a repeated string and of an anchor.
LENGTH, ANCHOR = 50, 20
#: Bytes of text of a chunk and of the part that is hashed at once, anchors of a bucket, contexts of an anchor that go on by single windows.
CHUNK_BYTES, PART_BYTES, BUCKET, HOT = 8 << 20, 1 << 20, 1_000_000, 20_000
#: Pieces of text that are gathered or sorted at once, whole groups at least.
PIECES = 20_000
#: A null id counts as this one, after all others.
NO_ID = (1 << 63) - 1
SINGLE, SORTED, WINDOWS = 0, 1, 2


def prefix_hashes(data):
    """Sums so that ``(sums[j] - sums[i]) * inverse[i]`` is the polynomial hash of bytes i to j."""
    import numpy as np

    power, inverse = _powers(len(data) + 1)
    return np.concatenate((np.zeros(1, "uint64"), np.cumsum((data.astype("uint64") + np.uint64(1)) * power[: len(data)]))), inverse


def _least_of(x, width: int):
    """Minima of ``width`` neighbours."""
    import numpy as np

    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def occurrences(data, ends, length: int = LENGTH):
    """Of texts behind each other, which end at ``ends``: first and last window, anchor's place and hash, and context's hash of each occurrence."""
    import numpy as np

    low, high, found = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000), []
    for at in range(0, max(0, len(data) - length + 1), PART_BYTES):
        part = data[at : at + PART_BYTES + length - 1]
        n = len(part) - length + 1
        sums, inverse = prefix_hashes(part)
        hashes = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(part) - ANCHOR + 1])
        place = (_least_of((hashes & high) | np.arange(len(hashes), dtype="uint64"), length - ANCHOR + 1) & low).astype("int64")
        inner = ends[(ends > at) & (ends < at + len(part))] - at  # windows over a text's end are none
        over = np.bincount(np.clip(inner - length + 1, 0, n), minlength=n + 1) - np.bincount(np.clip(inner, 0, n), minlength=n + 1)
        ok = np.cumsum(over)[:n] == 0
        turn = place[1:] != place[:-1]
        first = np.flatnonzero(ok & np.concatenate(([True], turn | ~ok[:-1])))
        last = np.flatnonzero(ok & np.concatenate((turn | ~ok[1:], [True])))
        p = place[first]
        shape = ((p - first) * 256 + (last - first)).astype("uint64")
        context = _mixed((sums[last + length] - sums[first]) * inverse[first] + shape * np.uint64(0xBF58476D1CE4E5B9))
        found.append((first + at, last + at, p + at, hashes[p], context))
    if not found:
        none = np.zeros(0, "int64")
        return none, none, none, none.astype("uint64"), none.astype("uint64")
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Analysis:
    """The occurrences of a chunk, its anchors and its classes (occurrences with one anchor and context); a function of the chunk alone."""

    def __init__(self, data, ids, sizes, buckets: int, length: int):
        import numpy as np

        self.data, self.length, self.buckets = data, length, buckets
        self.ends = np.cumsum(sizes)
        self.first, self.last, self.place, anchor, context = occurrences(data, self.ends, length)
        self.text = np.searchsorted(self.ends, self.first, side="right")
        self.doc = ids[self.text]
        anchor = _mixed(anchor + np.uint64(1))
        bucket = (anchor & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        self.key = (bucket << np.uint64(32)) | (anchor >> np.uint64(32))
        context = (context >> np.uint64(16)) | np.uint64(1)  # 48 bits, never 0
        order = np.lexsort((context, self.key))
        key, context, doc = self.key[order], context[order], self.doc[order]
        new_key = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
        new_class = new_key.copy()
        new_class[1:] |= context[1:] != context[:-1]
        self.class_at = np.flatnonzero(new_class)
        self.class_of = np.empty(len(key), "int64")
        self.class_of[order] = np.cumsum(new_class) - 1
        self.class_least = np.minimum.reduceat(doc, self.class_at) if len(key) else doc
        self.sample = order[self.class_at]  # an occurrence of each class
        anchors = np.flatnonzero(new_key[self.class_at])
        self.anchor_key = key[self.class_at[anchors]]
        self.anchor_of_class = np.cumsum(new_key[self.class_at]) - 1
        self.anchor_least = np.minimum.reduceat(self.class_least, anchors) if len(key) else doc
        self.contexts = np.diff(np.concatenate((anchors, [len(self.class_at)])))
        self.anchor_context = np.where(self.contexts == 1, context[self.class_at[anchors]], np.uint64(0))

    def states(self, replies: list) -> tuple:
        """By anchor: what the bucket said (-1 nothing), and the least document it named."""
        import numpy as np

        state, least = np.full(len(self.anchor_key), -1, "int8"), self.anchor_least.copy()
        for r in replies:
            n = r["n"]
            key = np.frombuffer(r["data"], "uint32", n).astype("uint64") | (np.uint64(r["bucket"]) << np.uint64(32))
            at = np.searchsorted(self.anchor_key, key)
            state[at] = np.frombuffer(r["data"], "int8", n, 4 * n)
            told = np.frombuffer(r["data"], "int64", n, 5 * n)
            single = state[at] == SINGLE
            least[at[single]] = told[single]
        return state, least

    def contexts_of(self, classes) -> tuple:
        """Texts, sizes, anchors' places in them, documents and groups of classes."""
        import numpy as np

        of = self.sample[classes]
        start, size = self.first[of], self.last[of] - self.first[of] + self.length
        return gathered(self.data, start, size), size, self.place[of] - start, self.class_least[classes], self.key[of]

    def windows_of(self, state) -> tuple:
        """The windows of anchors with very many contexts: occurrence and offset of each, its class among them, and of each class an example's start, least document and group."""
        import numpy as np

        of = np.flatnonzero(state[self.anchor_of_class[self.class_of]] == WINDOWS)
        count = self.last[of] - self.first[of] + 1
        of = np.repeat(of, count)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = self.first[of] + offset
        order, new = equal_windows(self.data, start, self.length)
        sample, which = order[new], np.empty(len(order), "int64")
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.doc[of[order]], np.flatnonzero(new)) if len(of) else self.doc[:0]
        power, hashes = _powers(self.length)[0], np.empty(len(sample), "uint64")
        for at in range(0, len(sample), PIECES):
            rows = self.data[start[sample[at : at + PIECES], None] + np.arange(self.length)].astype("uint64") + np.uint64(1)
            hashes[at : at + PIECES] = _mixed(_mixed((rows * power[: self.length]).sum(axis=1, dtype="uint64")) + np.uint64(7))
        group = (((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))
        return of, offset, which, start[sample], least, group


def gathered(data, start, size):
    """The bytes of many pieces behind each other."""
    import numpy as np

    out = [data[:0]]
    for k in range(0, len(size), PIECES):
        n = size[k : k + PIECES]
        out.append(data[np.repeat(start[k : k + PIECES] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return np.concatenate(out)


def words_of(data):
    """The eight bytes from each place on as a number, which orders as they do; zeros follow the end."""
    import numpy as np

    return np.ndarray(len(data), ">u8", np.concatenate((data, np.zeros(8, "uint8"))), strides=(1,))


def equal_windows(data, start, length: int):
    """The windows that begin at ``start`` in an order in which equal ones are neighbours, and whether each is unlike the one before it."""
    import numpy as np

    words, places = words_of(data), [*range(0, length - 8, 8), length - 8]
    hashes = np.zeros(len(start), "uint64")
    for k in places:
        hashes = _mixed(hashes + words[start + k].astype("uint64"))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    at = start[order]
    if any((words[at[1:] + k] != words[at[:-1] + k])[~new[1:]].any() for k in places):  # a collision of hashes: by the bytes
        keys = [words[start + k].astype("uint64") for k in places]
        order = np.lexsort(keys[::-1])
        new[1:] = False
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


def merge_sorted(items, start, size, compare: Callable):
    """Items in segments (of each: where its segment starts, and its size) in the order of ``compare``: all runs of a width are merged at once.

    An item's place is its place in its run plus the number of items of the other run
    before it, which a binary search finds.
    """
    import numpy as np

    width, local = 1, np.arange(len(items)) - start
    while len(active := np.flatnonzero(size > width)):
        at, base, x, total = local[active], start[active], items[active], size[active]
        run = at // width
        lo = np.minimum((run ^ 1) * width, total)
        hi, begin = np.minimum(lo + width, total), lo.copy()
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) // 2
            c = compare(x[todo], items[base[todo] + mid])
            before = (c > 0) | ((c == 0) & (run[todo] % 2 == 1))
            lo[todo], hi[todo] = np.where(before, mid + 1, lo[todo]), np.where(before, hi[todo], mid)
        items = items.copy()
        items[base + (run - run % 2) * width + (at - run * width) + (lo - begin)] = x
        width *= 2
    return items


def shared_windows(data, sizes, left, doc, group, length: int = LENGTH):
    """Of pieces of text: a bit for each window that also is in a piece of the group, of a smaller document, at the same distance from the anchor."""
    import numpy as np

    out = np.zeros(len(sizes), "int64")
    order, begin = np.argsort(group, kind="stable"), np.cumsum(sizes) - sizes
    edges = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))) if len(order) else order
    at = 0
    while at < len(order):  # some groups at a time
        stop = edges[np.searchsorted(edges, at + PIECES)] if at + PIECES <= edges[-1] else len(order)
        some = order[at:stop]
        out[some] = _shared(gathered(data, begin[some], sizes[some]), sizes[some], left[some], doc[some], group[some], length)
        at = stop
    return out


def _shared(data, sizes, left, doc, group, length: int):
    import numpy as np

    count = sizes - length + 1
    piece = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(sizes) - sizes, count) + offset
    order = np.lexsort((left[piece] - offset, group[piece]))
    piece, offset, start = piece[order], offset[order], start[order]
    new = np.ones(len(piece), bool)
    new[1:] = (group[piece][1:] != group[piece][:-1]) | ((left[piece] - offset)[1:] != (left[piece] - offset)[:-1])
    segment = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    sums, inverse = prefix_hashes(data)
    whole, words, told = (sums[start + length] - sums[start]) * inverse[start], words_of(data), length // 8 * 8
    items, settled = np.arange(len(piece)), np.zeros(len(piece), bool)

    def ties():
        """Places of items that tie with a neighbour, and their runs; runs of one hash are settled."""
        beside = ~new
        beside[:-1] |= ~new[1:]
        at = np.flatnonzero(beside & ~settled)
        run = np.cumsum(new[at]) - 1
        if len(at):
            first, own = np.flatnonzero(new[at]), whole[items[at]]
            same = (np.minimum.reduceat(own, first) == np.maximum.reduceat(own, first))[run]
            settled[at[same]] = True
            at = at[~same]
            run = np.cumsum(new[at]) - 1
        return at, run

    for k in range(0, told, 8):
        at, run = ties()
        word = words[start[items[at]] + k].astype("uint64")
        by = np.argsort(word, kind="stable")
        by = by[np.argsort(run[by], kind="stable")]
        items[at], word = items[at[by]], word[by]
        new[at[1:]] = (run[1:] != run[:-1]) | (word[1:] != word[:-1])

    def compare(a, b):
        i, j = start[a], start[b]
        common = np.full(len(a), told)
        step = 1 << ((length - told).bit_length() - 1) if told < length else 0
        while step:
            x, y = i + common, j + common
            fits = np.flatnonzero(common + step <= length)
            x, y = x[fits], y[fits]
            same = (sums[x + step] - sums[x]) * inverse[x] == (sums[y + step] - sums[y]) * inverse[y]
            common[fits[same]] += step
            step //= 2
        open_ = common < length
        at = np.minimum(common, length - 1)
        return np.where(open_, np.sign(data[i + at].astype("int16") - data[j + at]), 0)

    at, run = ties()
    first = np.flatnonzero(new[at])
    items[at] = merge_sorted(items[at], first[run], np.diff(np.concatenate((first, [len(at)])))[run], compare)
    size = np.diff(np.concatenate((begins, [len(piece)])))
    equal, wrong, tied = np.zeros(len(items), bool), [], np.flatnonzero(~new)
    for at in range(0, len(tied), 1 << 16):  # neighbours verified by their bytes
        here = tied[at : at + (1 << 16)]
        a, b = (data[start[items[k]][:, None] + np.arange(length)] for k in (here - 1, here))
        differ = a != b
        some, where = differ.any(axis=1), differ.argmax(axis=1)
        equal[here] = ~some
        rows = np.arange(len(here))
        wrong += segment[here[some & (a[rows, where] > b[rows, where])]].tolist()
    for s in set(wrong):  # a collision of hashes: this segment by its bytes
        own = slice(begins[s], begins[s] + size[s])
        texts = [data[start[k] : start[k] + length].tobytes() for k in items[own]]
        by = sorted(range(len(texts)), key=texts.__getitem__)
        items[own] = items[own][by]
        equal[own] = [k > 0 and texts[by[k]] == texts[by[k - 1]] for k in range(len(by))]
    out = np.zeros(len(sizes), "int64")
    if len(items):
        run = np.cumsum(~equal) - 1
        least = np.minimum.reduceat(doc[piece[items]], np.flatnonzero(~equal))
        gone = items[doc[piece[items]] > least[run]]
        out = np.bincount(piece[gone], weights=2.0 ** offset[gone], minlength=len(sizes)).astype("int64")  # distinct powers below 2 ** 53
    return out


def chunks_of(docs: DataFrame) -> DataFrame:
    """A written table of chunks: chunk, and the ids, sizes in bytes and compressed texts of its documents."""
    import pyarrow as pa

    ship(docs.sparkSession)
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary()), ("bytes", pa.int64())])

    def made(chunk: int, ids: list, texts: list) -> pa.RecordBatch:
        body = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        sizes = [len(t) for t in texts]
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((chunk, ids, sizes, body, sum(sizes)), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append(text.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield made(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield made(chunk, ids, texts)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return written(rows.mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, body binary, bytes long"), "suffix-chunks")


def _analysed(row: dict, buckets: int, length: int) -> Analysis:
    import numpy as np
    import pyarrow as pa

    data = np.frombuffer(pa.decompress(row["body"], decompressed_size=row["bytes"], codec="zstd"), "uint8") if row["bytes"] else np.zeros(0, "uint8")
    return Analysis(data, np.array([NO_ID if i is None else i for i in row["ids"]], "int64"), np.array(row["sizes"], "int64"), buckets, length)


def _each(f: Callable, schema):
    """A function of Arrow batches from one of single rows that yields tuples of columns' values."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                held, size = [], 0
                for out in f(row):
                    held.append(out)
                    size += sum(len(x) for x in out if isinstance(x, bytes))
                    if size > 4 << 20 or len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def _bounds(values) -> list[tuple[int, int]]:
    """The runs of equal values of an array."""
    import numpy as np

    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else [0]
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def anchor_replies(chunks: DataFrame, buckets: int, length: int) -> DataFrame:
    """A written table of what buckets say to chunks: chunk, bucket, n, and n anchors, states and least documents."""
    import pyarrow as pa

    entry = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("base", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])
    reply = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])

    def send(row):
        import numpy as np

        a = _analysed(row, buckets, length)
        many = np.minimum(np.ceil(np.log2(a.contexts)), 63).astype("uint8")
        for lo, hi in _bounds(a.anchor_key >> np.uint64(32)):
            least, context = a.anchor_least[lo:hi], a.anchor_context[lo:hi]
            base = int(least.min())
            span = int(least.max()) - base
            kind = np.min_scalar_type(span).str if span < 1 << 63 else "<i8"  # wider differences wrap, and wrap back
            away = (least - np.int64(base)).astype(kind)
            parts = ((a.anchor_key[lo:hi] & np.uint64(0xFFFFFFFF)).astype("uint32"), (context & np.uint64(0xFFFFFFFF)).astype("uint32"), (context >> np.uint64(32)).astype("uint16"), many[lo:hi], away)
            yield int(a.anchor_key[lo] >> np.uint64(32)), row["chunk"], hi - lo, base, kind, b"".join(x.tobytes() for x in parts)

    def settle(table: pa.Table) -> pa.Table:
        import numpy as np

        held = []
        for r in table.to_pylist():
            n, data = r["n"], r["data"]
            context = np.frombuffer(data, "uint32", n, 4 * n).astype("uint64") | (np.frombuffer(data, "uint16", n, 8 * n).astype("uint64") << np.uint64(32))
            doc = np.frombuffer(data, r["kind"], n, 11 * n).astype("int64") + np.int64(r["base"])
            held.append((np.frombuffer(data, "uint32", n), context, np.frombuffer(data, "uint8", n, 10 * n), doc, np.full(n, r["chunk"], "int64")))
        anchor, context, many, doc, chunk = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(anchor, kind="stable")
        anchor, context, many, doc, chunk = (x[order] for x in (anchor, context, many, doc, chunk))
        at = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        of = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
        met = np.diff(np.concatenate((at, [len(anchor)]))) > 1
        same = (np.minimum.reduceat(context, at) == np.maximum.reduceat(context, at)) & (np.minimum.reduceat(context, at) > 0)
        hot = np.add.reduceat(2.0 ** many, at) > HOT
        least = np.minimum.reduceat(doc, at)
        state = np.where(hot, WINDOWS, np.where(met, np.where(same, SINGLE, SORTED), -1))[of]
        tell = np.flatnonzero((state == WINDOWS) | (state == SORTED) | ((state == SINGLE) & (doc > least[of])))
        tell = tell[np.argsort(chunk[tell], kind="stable")]
        rows = []
        for lo, hi in _bounds(chunk[tell]):
            k = tell[lo:hi]
            rows.append((int(chunk[k[0]]), r["bucket"], len(k), anchor[k].tobytes() + state[k].astype("int8").tobytes() + least[of[k]].tobytes()))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, reply, strict=True)], schema=reply)

    entries = chunks.mapInArrow(_each(send, entry), "bucket int, chunk long, n int, base long, kind string, data binary")
    return written(entries.groupBy("bucket").applyInArrow(settle, "chunk long, bucket int, n int, data binary"), "suffix-anchors")


def sorted_replies(asked: DataFrame, buckets: int, length: int) -> DataFrame:
    """A written table of what the suffix sorts say: chunk, n, and n places in the chunk's list of pieces with their bits."""
    import pyarrow as pa

    piece = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])
    reply = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])

    def send(row):
        import numpy as np

        a = _analysed(row, buckets, length)
        state, _ = a.states(row["told"])
        classes = np.flatnonzero(state[a.anchor_of_class] == SORTED)
        data, size, left, doc, group = a.contexts_of(classes)
        _, _, _, start, least, own = a.windows_of(state)
        alone = np.full(len(start), length, "int64")
        data, size, left = np.concatenate((data, gathered(a.data, start, alone))), np.concatenate((size, alone)), np.concatenate((left, 0 * alone))
        doc, group = np.concatenate((doc, least)), np.concatenate((group, own))
        order = np.argsort(group, kind="stable")
        begin = np.cumsum(size) - size
        for lo, hi in _bounds(group[order] >> np.uint64(32)):
            k = order[lo:hi]
            parts = ((group[k] & np.uint64(0xFFFFFFFF)).astype("uint32"), k.astype("uint32"), doc[k], left[k].astype("uint8"), size[k].astype("uint8"), gathered(data, begin[k], size[k]))
            yield int(group[k[0]] >> np.uint64(32)), row["chunk"], len(k), b"".join(x.tobytes() for x in parts)

    def settle(table: pa.Table) -> pa.Table:
        import numpy as np

        held = []
        for r in table.to_pylist():
            n, data = r["n"], r["data"]
            read = lambda kind, at, data=data, n=n: np.frombuffer(data, kind, n, at * n)
            held.append((np.frombuffer(data, "uint8", offset=18 * n), read("uint8", 17).astype("int64"), read("uint8", 16).astype("int64"), read("int64", 8), read("uint32", 0), read("uint32", 4), np.full(n, r["chunk"], "int64")))
        data, size, left, doc, group, place, chunk = (np.concatenate(x) for x in zip(*held, strict=True))
        bits = shared_windows(data, size, left, doc, group, length)
        tell = np.flatnonzero(bits)
        tell = tell[np.argsort(chunk[tell], kind="stable")]
        rows = [(int(chunk[tell[lo]]), hi - lo, place[tell[lo:hi]].tobytes() + bits[tell[lo:hi]].tobytes()) for lo, hi in _bounds(chunk[tell])]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, reply, strict=True)], schema=reply)

    pieces = asked.mapInArrow(_each(send, piece), "bucket int, chunk long, n int, data binary")
    return written(pieces.groupBy("bucket").applyInArrow(settle, "chunk long, n int, data binary"), "suffix-sorted")


def removed(a: Analysis, told: list, sorted_: list):
    """The spans of a chunk's bytes that go: starts and ends, in order, none over a text's end."""
    import numpy as np

    length = a.length
    state, least = a.states(told)
    by_class = state[a.anchor_of_class]
    bits = np.zeros(len(a.class_at), "int64")
    sent = np.flatnonzero(by_class == SORTED)
    of, offset, which, start, own_least, _ = a.windows_of(state)
    window_bits = np.zeros(len(start), "int64")
    for r in sorted_:
        place, told_bits = np.frombuffer(r["data"], "uint32", r["n"]).astype("int64"), np.frombuffer(r["data"], "int64", r["n"], 4 * r["n"])
        inner = place < len(sent)
        bits[sent[place[inner]]] = told_bits[inner]
        window_bits[place[~inner] - len(sent)] = told_bits[~inner]
    alone = np.flatnonzero((by_class == -1) & (a.contexts[a.anchor_of_class] > 1))  # no other chunk has the anchor
    if len(alone):
        data, size, left, doc, group = a.contexts_of(alone)
        bits[alone] = shared_windows(data, size, left, doc, group, length)
    limit = np.minimum(a.class_least, np.where(by_class == SINGLE, least[a.anchor_of_class], NO_ID))
    whole = (a.doc > limit[a.class_of]) & (by_class[a.class_of] != WINDOWS)
    spans = [(a.first[whole], a.last[whole] + length)]
    some = np.flatnonzero(~whole & (bits[a.class_of] > 0))
    for k in range(length - ANCHOR + 1):
        x = some[(bits[a.class_of[some]] >> k) & 1 == 1]
        spans.append((a.first[x] + k, a.first[x] + k + length))
    gone = (a.doc[of] > own_least[which]) | (window_bits[which] > 0)
    spans.append((a.first[of[gone]] + offset[gone], a.first[of[gone]] + offset[gone] + length))
    begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    reach = np.maximum.accumulate(end) if len(end) else end
    text = np.searchsorted(a.ends, begin, side="right")
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return begin[at], reach[np.concatenate((at[1:], [len(begin)])) - 1] if len(at) else end


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_bytes, spans (start, end: maximal runs of removed bytes) and kept (the bytes left, which may cut a character).

    Strings of ``length`` bytes (of 21 to 70) of the texts' UTF-8 are judged on the input.
    Rows that share an id count as one document and keep what only they share; a null id
    comes after all others (and shares its rank with the greatest possible one); a null
    text is empty and stays so. Texts are never cut before they are compared, a long one
    is a chunk by itself. An empty table gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    if not ANCHOR < length <= ANCHOR + 50:
        raise ValueError("length must be from 21 to 70")
    chunks = chunks_of(docs)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total * 2 / (length - ANCHOR + 2) / BUCKET))
    replies = anchor_replies(chunks, buckets, length)
    told = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "data")).alias("told"))
    sorted_ = sorted_replies(chunks.join(told, "chunk"), buckets, length).groupBy("chunk").agg(F.collect_list(F.struct("n", "data")).alias("sorted"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])

    def finish(row):
        import numpy as np

        a = _analysed(row, buckets, length)
        begin, end = removed(a, row["told"] or [], row["sorted"] or [])
        first = np.searchsorted(begin, a.ends - np.array(row["sizes"], "int64"))
        after = np.searchsorted(begin, a.ends)
        data, at = a.data.tobytes(), 0
        for k, (doc, size) in enumerate(zip(row["ids"], row["sizes"], strict=True)):
            starts, ends = begin[first[k] : after[k]] - at, end[first[k] : after[k]] - at
            text = data[at : at + size]
            edges = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), size]
            yield doc, size, starts.tolist(), ends.tolist(), b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            at += size

    rows = chunks.join(told, "chunk", "left").join(sorted_, "chunk", "left")
    done = rows.mapInArrow(_each(finish, out), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return done.select("doc_id", "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "kept")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes left."""
    found = deduplicate(docs, length)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
