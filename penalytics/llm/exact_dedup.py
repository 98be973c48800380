"""Exact deduplication by Grace hashing.

1. Each task deduplicates what it reads in an open-addressing table that
   compares whole contents (the pre-aggregation: a text that fills a third of
   the corpus leaves one row for each task and table filling). The rows are
   written to the shared folder; only a group's representative carries text.
2. Representatives whose 64-bit hash occurs once are decided. The others are
   partitioned by that hash. A task fills a table of bounded bytes; records
   that it can't take go to spill files by further hash bits, and each spill
   file is treated in the same way, to any depth, until it fits.
3. The verdicts join the rows by (task, group), a key that holds no more than
   one task's rows.

Defined results: a null text counts as empty; of equal texts the row with the
largest id stays (a null id is the smallest; of equal ids the first row read);
repeated rows are separate rows of one group. An empty table gives no rows.
A text longer than a table goes to a spill file alone and is compared whole. Columns of any
other name pass through, whatever the name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import file_system, prepare_workers, scratch_path, shielded, stage, whole

TABLE_BYTES = 64 << 20
FANOUT_BITS = 4
#: Columns that the operator adds; no input column may start with this.
OWN = "__x_"


class OpenTable:
    """Open addressing with linear probing; entries are equal only if their whole contents are."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.slots = [-1] * 1024

    def _slot(self, code: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = (code ^ (code >> 32)) & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == code and self.texts[entry] == text:
                break
            at = (at + 1) & mask
        return at

    def find(self, code: int, text: bytes) -> int:
        """Entry number, or -1."""
        return self.slots[self._slot(code, text)]

    def has_room(self, text: bytes) -> bool:
        return not self.texts or self.used + len(text) + 200 <= self.limit

    def add(self, code: int, text: bytes) -> int:
        self.hashes.append(code)
        self.texts.append(text)
        self.used += len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for entry, (h, t) in enumerate(zip(self.hashes[:-1], self.texts[:-1])):
                self.slots[self._slot(h, t)] = entry
        self.slots[self._slot(code, text)] = len(self.texts) - 1
        return len(self.texts) - 1


def _rank(doc_id) -> tuple:
    return (doc_id is not None, doc_id if doc_id is not None else 0)


def _local(id_col: str, text_col: str, limit: int) -> Callable:
    """Deduplicate within a task, one table filling after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        table, held, group = OpenTable(limit), [], []
        best: list[tuple] = []  # of each entry: rank of its keeper, keeper's row, number of rows
        row = first = 0

        def flush():
            at = first
            for batch in held:
                mine = group[at - first: at - first + batch.num_rows]
                keeper = pa.array([best[g][1] for g in mine], pa.int64())
                rows = pa.array(range(at, at + batch.num_rows), pa.int64())
                columns = dict(zip(batch.schema.names, batch.columns))
                columns[text_col] = columns[text_col].take(pa.array(
                    [i if best[g][1] == at + i else None for i, g in enumerate(mine)], pa.int64()))
                columns.pop(f"{OWN}cmp")
                columns |= {
                    f"{OWN}part": pa.array([part] * batch.num_rows, pa.int64()), f"{OWN}row": rows,
                    f"{OWN}keeper": keeper, f"{OWN}kid": pa.array([best[g][3] for g in mine], columns[id_col].type),
                    f"{OWN}n": pa.array([best[g][2] for g in mine], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)
                at += batch.num_rows

        for batch in batches:
            names = batch.schema.names
            codes = batch.column(names.index(f"{OWN}hash")).to_pylist()
            texts, ids = batch.column(names.index(f"{OWN}cmp")), batch.column(names.index(id_col)).to_pylist()
            start = 0
            for i, code in enumerate(codes):
                text = texts[i].as_py()
                entry = table.find(code, text)
                if entry < 0:
                    if not table.has_room(text):
                        if i > start:
                            held.append(batch.slice(start, i - start))
                        yield from flush()
                        table, held, group, best = OpenTable(limit), [], [], []
                        start, first = i, row
                    entry = table.add(code, text)
                    best.append((_rank(ids[i]), row, 0, ids[i]))
                rank, keeper, n, kid = best[entry]
                better = _rank(ids[i]) > rank
                best[entry] = (_rank(ids[i]), row, n + 1, ids[i]) if better else (rank, keeper, n + 1, kid)
                group.append(entry)
                row += 1
            held.append(batch.slice(start))
            if sum(b.nbytes for b in held) > 2 * limit:  # many copies: the rows themselves must not pile up
                yield from flush()
                table, held, group, best, first = OpenTable(limit), [], [], [], row
        yield from flush()

    return run


def _grace(spill_uri: str, limit: int, id_type: pa.DataType) -> Callable:
    """Classes of the records of one hash partition; see the module's step 2."""
    record = pa.schema([("hash", pa.int64()), ("text", pa.binary()), ("part", pa.int64()), ("row", pa.int64()),
                        ("id", id_type), ("n", pa.int64())])
    out = pa.schema([(f"{OWN}part", pa.int64()), (f"{OWN}keeper", pa.int64()), (f"{OWN}to_part", pa.int64()),
                     (f"{OWN}to_row", pa.int64()), (f"{OWN}to_id", id_type), (f"{OWN}total", pa.int64())])

    def classes(batches: Iterator[pa.RecordBatch], level: int, fs, folder: str) -> Iterator[pa.RecordBatch]:
        table, members, spills, pending = OpenTable(limit), [], {}, {}

        def spill(bucket: int):
            if bucket not in spills:
                fs.create_dir(folder)
                path = f"{folder}/{uuid.uuid4().hex}.arrow"
                sink = fs.open_output_stream(path)
                spills[bucket] = (path, sink, pa.ipc.new_stream(sink, record))
            rows = pending.pop(bucket)
            spills[bucket][2].write_batch(pa.RecordBatch.from_pylist(rows, record))

        full = False
        for batch in batches:
            for r in batch.to_pylist():
                entry = table.find(r["hash"], r["text"])
                if entry < 0 and not full and table.has_room(r["text"]):
                    entry = table.add(r["hash"], r["text"])
                    members.append([])
                if entry >= 0:
                    members[entry].append((r["part"], r["row"], r["id"], r["n"]))
                    continue
                full = True  # from now on no text enters, so all copies of a spilled text are spilled
                bucket = (r["hash"] >> (FANOUT_BITS * (level + 1) % 64)) & ((1 << FANOUT_BITS) - 1)
                pending.setdefault(bucket, []).append(r)
                if sum(len(x["text"]) for x in pending[bucket]) > limit >> FANOUT_BITS or len(pending[bucket]) >= 256:
                    spill(bucket)
        for bucket in list(pending):
            spill(bucket)
        for _, sink, writer in spills.values():
            writer.close()
            sink.close()
        columns: list[list] = [[] for _ in out]
        for entry in members:
            part, row, kid, _ = max(entry, key=lambda m: (_rank(m[2]), -m[0], -m[1]))
            total = sum(m[3] for m in entry)
            for m in entry:
                for column, value in zip(columns, (m[0], m[1], part, row, kid, total)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
        del table, members
        for path, _, _ in spills.values():
            with fs.open_input_stream(path) as source:
                yield from classes(pa.ipc.open_stream(source), level + 1, fs, folder)
            fs.delete_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, folder = file_system(spill_uri)
        mine = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        yield from classes(batches, 0, fs, mine)
        if fs.get_file_info(mine).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(mine)

    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             normalise: Callable[[Column], Column] = lambda c: c, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows with their group within a task, and the classes of the groups that met others."""
    spark = docs.sparkSession
    prepare_workers(spark)
    content = normalise(whole(F.col(text_col)))
    keyed = docs.withColumns({f"{OWN}cmp": content.cast("binary"), f"{OWN}hash": F.xxhash64(content),
                              f"{OWN}sha256": F.sha2(content.cast("binary"), 256)})
    id_type = docs.schema[id_col].dataType
    long = T.LongType()
    extra = [(f"{OWN}part", long), (f"{OWN}row", long), (f"{OWN}keeper", long), (f"{OWN}kid", id_type), (f"{OWN}n", long)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema if f.name != f"{OWN}cmp"]
                          + [T.StructField(n, t) for n, t in extra])
    rows = stage(keyed.mapInArrow(_local(id_col, text_col, table_bytes), schema), "dedup-rows")

    reps = rows.where(f"{OWN}row = {OWN}keeper")
    again = reps.groupBy(f"{OWN}hash").agg(F.count("*").alias("c")).where("c > 1").select(f"{OWN}hash")
    contested = reps.join(again, f"{OWN}hash", "left_semi").select(
        F.col(f"{OWN}hash").alias("hash"), normalise(whole(F.col(text_col))).cast("binary").alias("text"),
        F.col(f"{OWN}part").alias("part"), F.col(f"{OWN}row").alias("row"), F.col(id_col).alias("id"),
        F.col(f"{OWN}n").alias("n")).repartition("hash")
    verdict_schema = T.StructType([T.StructField(f"{OWN}part", long), T.StructField(f"{OWN}keeper", long),
                                   T.StructField(f"{OWN}to_part", long), T.StructField(f"{OWN}to_row", long),
                                   T.StructField(f"{OWN}to_id", id_type), T.StructField(f"{OWN}total", long)])
    verdicts = stage(contested.mapInArrow(
        _grace(scratch_path(spark, "dedup-spill"), table_bytes, to_arrow_type(id_type)), verdict_schema), "dedup-classes")
    return rows, verdicts


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    plain, (i, t) = shielded(docs.select(id_col, text_col), id_col, text_col)
    rows, verdicts = classify(plain, i, t, **options)
    slim = rows.select(F.col(i).alias(id_col), *[f"{OWN}{c}" for c in ("sha256", "part", "row", "keeper", "kid", "n")])
    both = slim.join(verdicts, [f"{OWN}part", f"{OWN}keeper"], "left")
    settled = F.col(f"{OWN}total").isNull()
    local = F.col(f"{OWN}row") == F.col(f"{OWN}keeper")
    first = (F.col(f"{OWN}to_part") == F.col(f"{OWN}part")) & (F.col(f"{OWN}to_row") == F.col(f"{OWN}row"))
    return both.select(
        F.col(id_col), F.when(settled, F.col(f"{OWN}kid")).otherwise(F.col(f"{OWN}to_id")).alias("keep_id"),
        F.coalesce(f"{OWN}total", f"{OWN}n").alias("group_size"),
        F.when(settled, local).otherwise(first).alias("kept"), F.col(f"{OWN}sha256").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    plain, (i, t) = shielded(docs, id_col, text_col)
    rows, verdicts = classify(plain, i, t, **options)
    losers = verdicts.where(f"{OWN}part <> {OWN}to_part or {OWN}keeper <> {OWN}to_row").select(
        f"{OWN}part", F.col(f"{OWN}keeper").alias(f"{OWN}row"))
    reps = rows.where(f"{OWN}row = {OWN}keeper")
    return reps.join(losers, [f"{OWN}part", f"{OWN}row"], "left_anti").select(*plain.columns).toDF(*docs.columns)
