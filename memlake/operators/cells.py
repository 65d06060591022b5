"""The best rows of every query where queries share words with most rows: cells of rows, each with all queries.

Queries times rows that they meet can be far more than either, so such pairs
are made within a task and only the best of a cell leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows (documents, memories) of a cell, about.
CELL = 4_096


def cells_of(rows: int) -> int:
    return max(1, -(-rows // CELL))


def everywhere(df: DataFrame, cells: int) -> DataFrame:
    return df.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).groupBy("cell")


def dealt(df: DataFrame, key: str, cells: int) -> DataFrame:
    return df.withColumn("cell", F.pmod(F.xxhash64(key), F.lit(cells)).cast("int"))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, and the values."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _ranks(values: pa.Array) -> np.ndarray:
    """Place of each value in their order; strings by bytes."""
    out = np.empty(len(values), np.int64)
    out[pc.array_sort_indices(values).to_numpy()] = np.arange(len(values))
    return out


class _Lists:
    """Rows by word: which rows, and what else, stands in a stretch for each word."""

    def __init__(self, words: pa.ChunkedArray, *columns: np.ndarray):
        code, self.words = _codes(words)
        order = np.argsort(code, kind="stable")
        self.columns = [c[order] for c in columns]
        self.ends = np.searchsorted(code[order], np.arange(len(self.words) + 1))

    def stretch(self, codes: np.ndarray) -> list[np.ndarray]:
        """The columns of some words' rows."""
        return [np.concatenate([c[self.ends[k] : self.ends[k + 1]] for k in codes] or [c[:0]]) for c in self.columns]


def best_sums(asked: DataFrame, parts: DataFrame, by: str, rows: int, k: int) -> DataFrame:
    """``query_id, id, total``: the sums of ``part`` (all above 0) of parts (``by``, id, part) over the words of asked (query_id, ``by``); of each cell the k greatest of a query, ties by id. ``rows``: ids, about."""

    def run(asked: pa.Table, parts: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        empty = pa.table({"query_id": asked.column("query_id").slice(0, 0), "id": parts.column("id").slice(0, 0), "total": pa.array([], pa.float64())})
        if asked.num_rows and parts.num_rows:
            row, ids = _codes(parts.column("id"))
            lists, rank = _Lists(parts.column(by), row, parts.column("part").to_numpy()), _ranks(ids)
            query, queries = _codes(asked.column("query_id"))
            word = pc.fill_null(pc.index_in(asked.column(by), value_set=lists.words), -1).to_numpy()
            order = np.argsort(query, kind="stable")
            ends = np.searchsorted(query[order], np.arange(len(queries) + 1))
            for q in range(len(queries)):
                codes = word[order[ends[q] : ends[q + 1]]]
                at, part = lists.stretch(codes[codes >= 0])
                total = np.bincount(at, part, len(ids))
                found = np.flatnonzero(total)
                near = np.round(total[found], 9)
                if len(found) > k:
                    keep = near >= np.partition(near, -k)[-k]
                    found, near = found[keep], near[keep]
                found = found[np.lexsort((rank[found], -near))[:k]]
                if len(found):
                    out.append(pa.table({"query_id": pa.chunked_array([queries.take(pa.array(np.full(len(found), q)))]), "id": ids.take(pa.array(found)), "total": total[found]}))
        return pa.concat_tables([empty, *out]).combine_chunks()

    cells = cells_of(rows)
    types = {**dict(asked.dtypes), **dict(parts.dtypes)}
    left = everywhere(asked.select("query_id", by), cells)
    right = dealt(parts.select(by, "id", F.col("part").cast("double").alias("part")), "id", cells).groupBy("cell")
    return left.cogroup(right).applyInArrow(lambda a, b: run(a, b), f"query_id {types['query_id']}, id {types['id']}, total double")


RECALLED = "session {}, memory_id {}, hits long, is_foreign int, confidence double"


def recalled_in_cell(asked: pa.Table, held: pa.Table, most: int) -> pa.Table:
    """The rows of ``best_recalls`` of one cell; held has what was shown too, with a session."""
    out = []
    seen = held.filter(pc.is_valid(held.column("session")))
    held = held.filter(pc.is_valid(held.column("token")))
    if asked.num_rows and held.num_rows:
        row, ids = _codes(held.column("memory_id"))
        rank, first = _ranks(ids), np.unique(row, return_index=True)[1]
        lists = _Lists(held.column("token"), row, held.column("naming").to_numpy())
        one = held.take(pa.array(first))
        anywhere, confidence = one.column("anywhere").to_numpy(), one.column("confidence").to_numpy()
        confidence = np.where(np.isnan(confidence), -np.inf, confidence)
        repo = np.array(one.column("repo_id").to_pylist(), object)
        here_rows = {r: repo == r for r in set(asked.column("here").to_pylist()) if r is not None}
        hidden: dict = {}
        gone = pc.fill_null(pc.index_in(seen.column("memory_id"), value_set=ids), -1).to_numpy()
        for s, m in zip(seen.column("session").to_pylist(), gone.tolist(), strict=True):
            if m >= 0:
                hidden.setdefault(s, []).append(m)
        tokens = asked.column("tokens").combine_chunks()
        # of all prompts at once: each look-up hashes the words of the cell anew
        words = pc.fill_null(pc.index_in(tokens.flatten(), value_set=lists.words), -1).to_numpy()
        words = np.split(words, np.cumsum(pc.list_value_length(tokens).to_numpy())[:-1])
        for s, here, codes in zip(asked.column("session").to_pylist(), asked.column("here").to_pylist(), words, strict=True):
            at, naming = lists.stretch(codes[codes >= 0])
            every = np.bincount(at, minlength=len(ids))
            named = np.bincount(at[naming], minlength=len(ids)) if naming.any() else np.zeros(len(ids), np.int64)
            local = np.ones(len(ids), bool) if here is None else anywhere | here_rows[here]
            fits = np.where(local, (every >= 2) | (named > 0), (every >= 2) & (named > 0))
            if s in hidden:
                fits[hidden[s]] = False
            found = np.flatnonzero(fits)
            hits = every[found] + named[found]
            first_by = np.where(local[found], hits + (1 << 40), hits)
            if len(found) > most:
                keep = first_by >= np.partition(first_by, -most)[-most]
                found, hits, first_by = found[keep], hits[keep], first_by[keep]
            order = np.lexsort((rank[found], -confidence[found], -first_by))[:most]
            out += [(s, ids[int(i)].as_py(), int(h), int(not local[i]), None if confidence[i] == -np.inf else float(confidence[i])) for i, h in zip(found[order], hits[order], strict=True)]
    columns = zip(*out, strict=True) if out else ((),) * 5
    kinds = (asked.schema.field("session").type, held.schema.field("memory_id").type, pa.int64(), pa.int32(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["session", "memory_id", "hits", "is_foreign", "confidence"])


def best_recalls(asked: DataFrame, held: DataFrame, shown: DataFrame | None, rows: int, most: int) -> DataFrame:
    """``session, memory_id, hits, is_foreign, confidence``: of each cell the first ``most`` memories of a session by the rule of ``search.prompt_recall``.

    asked: session, here, tokens (an array); held: memory_id, token, naming,
    repo_id, anywhere (local to every prompt), confidence; shown: session, memory_id.
    """

    cells = cells_of(rows)
    types = {**dict(asked.dtypes), **dict(held.dtypes)}
    right = held.select("memory_id", "token", "naming", "repo_id", "anywhere", F.col("confidence").cast("double").alias("confidence")).withColumn("session", F.lit(None).cast(types["session"]))
    if shown is not None:
        right = right.unionByName(shown.select("memory_id", F.col("session").cast(types["session"]).alias("session")), allowMissingColumns=True)
    right = dealt(right, "memory_id", cells).groupBy("cell")
    return everywhere(asked.select("session", "here", "tokens"), cells).cogroup(right).applyInArrow(lambda a, b: recalled_in_cell(a, b, most), RECALLED.format(types["session"], types["memory_id"]))


def groups_met(groups: DataFrame, held: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """``query_id, id, hits``: of each pair held (query_id, id) how many of the query's groups (query_id, place, word; any number of words a place) have a word among the row's terms (docs: id, terms), where any has."""

    def run(asked: pa.Table, both: pa.Table) -> pa.Table:
        docs, pairs = both.filter(pc.is_valid(both.column("terms"))), both.filter(pc.is_valid(both.column("query_id")))
        out = [pa.table({"query_id": pairs.column("query_id").slice(0, 0), "id": pairs.column("id").slice(0, 0), "hits": pa.array([], pa.int64())})]
        if asked.num_rows and docs.num_rows and pairs.num_rows:
            word, words = _codes(asked.column("word"))
            terms = docs.column("terms").combine_chunks()
            row = np.repeat(np.arange(docs.num_rows), pc.list_value_length(terms).to_numpy())
            term = pc.fill_null(pc.index_in(terms.flatten(), value_set=words), -1).to_numpy()
            row, term = row[term >= 0], term[term >= 0]
            row = row[np.argsort(term, kind="stable")]
            ends = np.searchsorted(np.sort(term), np.arange(len(words) + 1))
            ids = docs.column("id").combine_chunks()
            query, queries = _codes(pairs.column("query_id"))
            at = pc.fill_null(pc.index_in(pairs.column("id"), value_set=ids), -1).to_numpy()
            of = pc.fill_null(pc.index_in(asked.column("query_id"), value_set=queries), -1).to_numpy()
            place = asked.column("place").to_numpy()
            groups, wants = np.argsort(of, kind="stable"), np.argsort(query, kind="stable")
            group_ends, want_ends = (np.searchsorted(np.sort(x), np.arange(len(queries) + 1)) for x in (of, query))
            for q in range(len(queries)):
                mine, some = groups[group_ends[q] : group_ends[q + 1]], at[wants[want_ends[q] : want_ends[q + 1]]]
                met = np.zeros((place[mine].max(initial=-1) + 1, docs.num_rows), bool)
                for p, w in zip(place[mine], word[mine], strict=True):
                    met[p, row[ends[w] : ends[w + 1]]] = True
                some = some[some >= 0]
                hits = met.sum(axis=0)[some]
                some, hits = some[hits > 0], hits[hits > 0]
                if len(some):
                    out.append(pa.table({"query_id": pa.chunked_array([queries.take(pa.array(np.full(len(some), q)))]), "id": pa.chunked_array([ids.take(pa.array(some))]), "hits": pa.array(hits, pa.int64())}))
        return pa.concat_tables(out).combine_chunks()

    cells = cells_of(rows)
    kind, key = dict(held.dtypes)["query_id"], dict(held.dtypes)["id"]
    right = docs.select("id", "terms").unionByName(held.select("id", "query_id"), allowMissingColumns=True)
    left = everywhere(groups.select("query_id", F.col("place").cast("int").alias("place"), "word"), cells)
    return left.cogroup(dealt(right, "id", cells).groupBy("cell")).applyInArrow(lambda a, b: run(a, b), f"query_id {kind}, id {key}, hits long")
