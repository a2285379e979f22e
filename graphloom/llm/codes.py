"""Vector code compression with exact integer codebooks, by exponion search.

Every part of a vector goes to its codebook's nearest entry. The search starts at the part's previous entry a, at a distance e, and scans
the list of a's neighbour entries, sorted by their distance from a. An entry that is further than 2e from a is further than e from the part
(triangle inequality), so that the scan ends there: in squared integers, where D > 4E. All distances are exact, and ties go to the
smaller index. A round writes the table again with its codes, which the next one starts from, and beside them a task's sums by entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import drop, prepare, stage, trim
from graphloom.llm.vectors import as_long, distance_type, flat, grouped_sums, integers, long_sum, squared

ROWS = 16_384  # vectors of a block, at most
TERMS = 2 << 20  # components of a block, at most (or one row)
STEP = 64  # neighbour entries that are scanned at once


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, distance): for every entry all entries by their squared distance from it, and these distances."""
    d = squared(book, book)
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.take_along_axis(d, order, 1)


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray, order: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, distances computed) of each row, searched from the entries `start`; ties go to the smaller index."""
    off = x - book[start]
    least, entry, done = (off * off).sum(1), start.copy(), len(x)
    by = np.argsort(start, kind="stable")
    entries, first = np.unique(start[by], return_index=True)
    for a, rows in zip(entries.tolist(), np.split(by, first[1:]), strict=True):
        reach = np.searchsorted(distance[a], 4 * least[rows], side="right")
        falling = np.argsort(-reach, kind="stable")
        rows, reach = rows[falling], reach[falling]
        for at in range(0, int(reach[0]), STEP):
            live = rows[: np.searchsorted(-reach, -at)]
            found = np.sort(order[a][at : at + STEP])
            d = squared(x[live], book[found])
            done += d.size
            low = d.argmin(1)
            d, low = d[np.arange(len(live)), low], found[low]
            better = (d < least[live]) | ((d == least[live]) & (low < entry[live]))
            least[live[better]], entry[live[better]] = d[better], low[better]
    return entry, least, done


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of up to ROWS rows and about TERMS components, and their vectors as a matrix."""

    def cut(held):
        t = pa.Table.from_batches(held).combine_chunks()
        return t, flat(t.column(column).chunk(0))[0].reshape(-1, dim)

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS or rows * dim >= TERMS:
            yield cut(held)
            held, rows = [], 0
    if held:
        yield cut(held)


def _searched(books: np.ndarray, x: np.ndarray, codes: np.ndarray, ready: dict) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors) of a block: every part from its previous code. ready: neighbour lists by type and part."""
    out, errors = codes.copy(), np.zeros(len(x), object)
    for p, book in enumerate(books):
        part = x[:, p * book.shape[1] : (p + 1) * book.shape[1]]
        kind = distance_type(part, book)
        if (kind, p) not in ready:
            entries = book.astype(kind)
            ready[kind, p] = (entries, *neighbours(entries))
        out[:, p], error, _ = nearest(part.astype(kind), codes[:, p], *ready[kind, p])
        errors = errors + (error.astype(np.int64) if kind is np.float64 else error).astype(object)
    return out, errors


def _round(books: np.ndarray, fresh: bool):
    """mapInArrow: (vec_id, label, vec, code) -> the same with new codes, and a task's sums as rows (part, entry, n, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        ready, n, total = {}, {}, {}
        names = ["vec_id", "label", "vec", "code", "part", "entry", "n", "sums"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        like = None
        for t, x in _blocks(batches, 2, parts * width):
            like = t.schema
            codes = np.zeros((len(x), parts), np.int32) if fresh else flat(t.column(3).chunk(0))[0].reshape(-1, parts)
            codes, _ = _searched(books, x, codes, ready)
            for p in range(parts):
                for e, w, s in zip(*grouped_sums(x[:, p * width : (p + 1) * width], codes[:, p]), strict=True):
                    n[p, e] = n.get((p, e), 0) + int(w)
                    total[p, e] = [a + b for a, b in zip(total[p, e], s, strict=True)] if (p, e) in total else s
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            out = pa.Table.from_arrays([*(t.column(c) for c in range(3)), code, *(pa.nulls(len(x), k) for k in kinds)], names)
            yield from out.to_batches(1024)
        if n:
            keys = sorted(n)
            sums = [pa.array([k[0] for k in keys], kinds[0]), pa.array([k[1] for k in keys], kinds[1]), pa.array([n[k] for k in keys], kinds[2]), pa.array([total[k] for k in keys], kinds[3])]
            none = [pa.nulls(len(keys), like.field(c).type) for c in range(3)] + [pa.nulls(len(keys), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(none + sums, names)
        trim()

    return run


def _coded(books: np.ndarray, fresh: bool):
    """mapInArrow: (vec_id, label, vec, code) -> (vec_id, label, code in hex digits, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        digits = max(2, len(f"{entries - 1:x}"))
        ready = {}
        for t, x in _blocks(batches, 2, parts * width):
            codes = np.zeros((len(x), parts), np.int32) if fresh else flat(t.column(3).chunk(0))[0].reshape(-1, parts)
            codes, errors = _searched(books, x, codes, ready)
            text = pa.array(["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()])
            out = pa.Table.from_arrays([t.column(0), t.column(1), text, pa.array(as_long(errors))], ["vec_id", "label", "code", "error"])
            yield from out.to_batches(1024)
        trim()

    return run


def updated(books: np.ndarray, rows: list) -> np.ndarray:
    """The codebooks with the entries of `rows` (part, entry, j, n, total) replaced by floor(total / n); the others stay."""
    out = books.copy()
    for r in rows:
        out[r.part, r.entry, r.j] = int(r.total) // r.n
    return out


def _learn(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(rows with their last codes, codebooks (part, entry, position)) after all rounds; rows is a staged table (vec_id, label, vec)."""
    first = rows.filter("vec_id is not null").orderBy("vec_id", "vec").select("vec").limit(entries).collect()
    if not first:
        return rows, np.zeros((parts, 0, 0), np.int64)
    books = np.array([r.vec for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    own = [f for f in rows.schema.fields if f.name in ("vec_id", "label", "vec")]
    made = T.StructType([*own, *T._parse_datatype_string("code array<int>, part int, entry int, n long, sums array<decimal(38,0)>").fields])
    now, table = rows, rows
    for _ in range(rounds):
        new = stage(now.mapInArrow(_round(books, table is rows), made), "codes")
        sums = new.filter("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("j", "s"))
        books = updated(books, sums.groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("total")).collect())
        drop(table)
        now, table = new.filter("part is null").select("vec_id", "label", "vec", "code"), new
    return now, books


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Codes of floor(factor * component) in `parts` equal parts, over codebooks of `entries` entries.

    Dropped are vectors that are null or hold null or non-finite components. Codebooks start as the parts of the smallest vec_ids (ties, of
    repeated ids: by the vector); rows with a null id are coded but start no entry. Fewer kept vectors make codebooks as small, whose entries
    may be equal: then the smaller index is used. Returns (vec_id, code, error, label_error, codebooks_sha256); label_error sums over equal labels, nulls
    together. Codebooks need one length: vectors of another length than most kept vectors have (ties: the longer), and vectors whose
    length is no positive multiple of `parts`, are dropped too; without any id in the rest there is no codebook and no row.
    Repeated ids are rows of their own. Components and errors are cut to a long's range. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = prepare(vectors.sparkSession)
    rows = integers(vectors, factor, vec_col, id_col, label_col)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), "vec")
    size = rows.groupBy(F.size("vec").alias("dim")).count().filter((F.col("dim") > 0) & (F.col("dim") % parts == 0)).orderBy(F.desc("count"), F.desc("dim")).first()
    rows = stage(rows.filter(F.size("vec") == (size.dim if size else -1)), "integers")
    rows, books = _learn(rows, parts, entries, rounds)
    if not books.size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    label = next(f for f in rows.schema.fields if f.name == "label")
    kind = T.StructType([T.StructField("vec_id", T.LongType()), label, *T._parse_datatype_string("code string, error long").fields])
    # Written first, so that the join below reads two plain exchanges, of which a hot label can be split.
    coded = stage(rows.mapInArrow(_coded(books, "code" not in rows.columns), kind), "coded")
    by_label = stage(coded.groupBy("label").agg(long_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024) -> str:
    """The same in SQL: every round joins all parts with their whole codebook."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    near{r} as materialized (
        select v.node, v.p, min(cast(list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, b.c) + list_dot_product(b.c, b.c) as bigint) * {entries} + b.e) as best
        from parts v join book{r} b using (p) group by v.node, v.p)""")
        if r < rounds:
            steps.append(f"""
    sums{r} as (
        select p, e, j, sum(cast(x as hugeint)) as s, count(*) as n
        from (select p, n.best % {entries} as e, generate_subscripts(v.v, 1) as j, unnest(v.v) as x from near{r} n join parts v using (node, p)) group by p, e, j),
    means{r} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as double) order by j) as c from sums{r} group by p, e),
    book{r + 1} as materialized (select o.p, o.e, coalesce(m.c, o.c) as c from book{r} o left join means{r} m using (p, e))""")
    return f"""
    with kept as materialized (
        select row_number() over (order by vec_id, v) as node, vec_id, label, v
        from (select vec_id, label, list_transform(embedding, lambda x: floor({factor} * cast(x as double))) as v from embeddings
            where len(embedding) > 0 and len(embedding) % {parts} = 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
    parts as materialized (
        select node, cast(p as bigint) as p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] as v from kept, range({parts}) t(p)),
    book0 as materialized (select p, node - 1 as e, v as c from parts where node <= {entries}),{",".join(steps)},
    coded as (
        select k.vec_id, k.label, string_agg(lower(printf('%02x', n.best % {entries})), '' order by n.p) as code, cast(sum(n.best // {entries}) as bigint) as error
        from near{rounds} n join kept k using (node) group by k.node, k.vec_id, k.label),
    book as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ','), ',' order by p, e)) as h from book{rounds})
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select h from book) as codebooks_sha256 from coded"""
