"""What a search does in Arrow batches: the asked terms of documents packed a row each, and the best documents of every question.

A document's tokens meet the asked terms where they are made, and a document's scores come about in the task that reads it, so
nothing is shuffled but each task's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldloom.config import BM25_B, BM25_K1, FIELD_WEIGHTS

#: documents that are packed or weighed at a time, and postings that are scored at a time
SLICE, BLOCK = 1_000, 3_000_000
#: scores that agree to so many places are ties
PLACES = 9
#: columns of packed documents beside doc_id; a task's last row has statistics only, and no names
PACKED = "doc_type string, names array<string>, lens array<int>, terms array<array<int>>, tfs array<array<int>>, types array<string>, seen array<array<int>>, dfs array<array<bigint>>, fields array<string>, rows array<bigint>, totals array<bigint>"


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def _lists(sizes: np.ndarray, values: np.ndarray | pa.Array, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(_ends(sizes), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(x: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct values, and the place among them of each row."""
    d = pc.dictionary_encode(x, null_encoding="encode")
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def pack(words: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, doc_type, names, tokens) to (doc_id, PACKED). A term is its place in words, once a field with its frequency; at the end of a
    task, of each type how many documents hold a term, of each field how many there are and their lengths' sum, empty ones counting as 1."""
    most = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfs: dict[str | None, np.ndarray] = {}
        totals: dict[str | None, np.ndarray] = {}
        none, kinds = None, None
        for b in _slices(batches):
            ids, types, names, tokens = (b.column(c) for c in ("doc_id", "doc_type", "names", "tokens"))
            each, of = _sizes(names), tokens.flatten()  # fields of a document; the tokens of each field
            lens = _sizes(of)
            found = pc.fill_null(pc.index_in(of.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.repeat(np.arange(len(lens)), lens)[found >= 0]
            key, tf = np.unique(at * most + found[found >= 0], return_counts=True)
            field, term = np.divmod(key, max(most, 1))
            doc = np.repeat(np.arange(len(each)), each)
            held, term_of = np.divmod(np.unique(doc[field] * most + term), max(most, 1))
            kind, kind_at = _codes(types)
            for i, t in enumerate(kind):
                dfs[t] = dfs.get(t, 0) + np.bincount(term_of[kind_at[held] == i], minlength=most)
            field_names, name_at = _codes(names.flatten())
            for i, t in enumerate(field_names):
                own = lens[name_at == i]
                totals[t] = totals.get(t, 0) + np.array([len(own), np.maximum(own, 1).sum()])
            sizes = np.bincount(field, minlength=len(lens))
            cut = lambda x: pa.ListArray.from_arrays(_ends(each), _lists(sizes, x, pa.int32()))  # noqa: E731, B023
            rows = [ids, types, pa.ListArray.from_arrays(_ends(each), names.flatten()), _lists(each, lens, pa.int32()), cut(term), cut(tf)]
            none, kinds = [pa.nulls(1, x.type) for x in rows], ids.type
            yield _packed([*rows, *(pa.nulls(len(ids), t) for t in _STATISTICS)])
        if kinds is not None:
            own = [(t, np.flatnonzero(n)) for t, n in dfs.items()]
            yield _packed([*none, *(pa.array([x], t) for x, t in zip(([t for t, _ in own], [n for _, n in own], [dfs[t][n] for t, n in own], list(totals), [x[0] for x in totals.values()], [x[1] for x in totals.values()]), _STATISTICS, strict=True))])

    return run


_STATISTICS = (pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))


def _packed(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *(c.split()[0] for c in PACKED.split(", "))])


def best(
    asked: pa.Array, ends: np.ndarray, terms: np.ndarray, channel_of: dict[str, int], names: list[str], depths: list[int], idf: np.ndarray, lengths: dict[str, float],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, PACKED) to (asked, channel, doc_id, raw): in each channel the best documents of each question among those of a block, ties by doc_id.

    terms[ends[i]:ends[i + 1]] are those of question i. idf has a row for each channel and a column for each term. A later block of a
    task leaves out what is below the best of an earlier one.
    """
    wanted = np.zeros(idf.shape[1], bool)
    wanted[terms] = True

    def block(channel: int, parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]], least: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([p[0] for p in parts])
        n, before = len(ids), np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        key = np.concatenate([p[2].astype(np.int64) * n + place[p[1] + b] for p, b in zip(parts, before, strict=False)])
        part = np.concatenate([p[3] for p in parts])
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        worth = np.add.reduceat(part[by], first) if len(first) else np.zeros(0)
        term, doc = np.divmod(key[first], n)
        start = np.searchsorted(term, np.arange(idf.shape[1] + 1))
        k, got = depths[channel], []
        for q in range(len(ends) - 1):
            own = terms[ends[q] : ends[q + 1]]
            runs = [(a, b) for a, b in zip(start[own].tolist(), start[own + 1].tolist(), strict=True) if b > a]
            if not runs:
                continue
            raw = np.bincount(np.concatenate([doc[a:b] for a, b in runs]), np.concatenate([worth[a:b] for a, b in runs]), n)
            at = np.flatnonzero(raw >= max(least[q] - 2 * 10.0**-PLACES, 1e-300))
            if len(at) >= k:
                top = np.rint(raw[at] * 10.0**PLACES)
                cut = np.partition(top, len(at) - k)[len(at) - k]
                least[q] = max(least[q], cut / 10.0**PLACES)
                over = np.flatnonzero(top > cut)
                at = at[np.concatenate((over, np.flatnonzero(top == cut)[: k - len(over)]))]
            got.append((np.full(len(at), q), order[at], raw[at]))
            if len(got) >= 5_000:
                yield out(channel, ids, got)
                got = []
        if got:
            yield out(channel, ids, got)

    def out(channel: int, ids: pa.Array, got: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        q, at, raw = (np.concatenate(x) for x in zip(*got, strict=True))
        return pa.RecordBatch.from_arrays([asked.take(pa.array(q)), pa.array([names[channel]] * len(q), pa.string()), ids.take(pa.array(at)), pa.array(raw)], ["asked", "channel", "doc_id", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {c: [] for c in range(len(names))}
        least = {c: np.zeros(len(ends) - 1) for c in held}
        for b in _slices(batches):
            kinds, kind_at = _codes(b.column("doc_type"))
            channel = np.array([channel_of.get(t, -1) for t in kinds], np.int64)[kind_at]
            each, inner = _sizes(b.column("names")), b.column("terms").flatten()
            doc, sizes = np.repeat(np.arange(len(each)), each), _sizes(inner)
            term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (inner, b.column("tfs").flatten()))
            field_names, name_at = _codes(b.column("names").flatten())
            weight = np.array([FIELD_WEIGHTS.get(f, 1.0) for f in field_names])[name_at]
            long = np.maximum(b.column("lens").flatten().to_numpy(zero_copy_only=False), 1) / np.array([lengths.get(f, 1.0) for f in field_names])[name_at]
            field = np.repeat(np.arange(len(sizes)), sizes)
            for c in held:
                use = (channel[doc[field]] == c) & wanted[term]
                f, t, n = field[use], term[use], tf[use]
                part = weight[f] * idf[c, t] * n * (BM25_K1 + 1) / (n + BM25_K1 * (1 - BM25_B + BM25_B * long[f]))
                mine = np.flatnonzero(channel == c)
                if len(mine):
                    held[c].append((b.column("doc_id").take(pa.array(mine)), np.searchsorted(mine, doc[f]), t, part))
                if sum(len(p[2]) for p in held[c]) >= BLOCK:
                    yield from block(c, held[c], least[c])
                    held[c] = []
        for c, parts in held.items():
            if parts:
                yield from block(c, parts, least[c])

    return run
