"""Record logs as a Python data source: windows of row-oriented and columnar files, read side by side, and a writer that never overwrites.

``spark.dataSource.register(TapeSource)``, then ``spark.read.format("tapelog").load(window)``. Options: ``mode`` (``records``, the
records; ``index``, the columnar files' index columns beside them; ``footers``, one row for each batch, bodies passed over;
``profile``, what each file is made of), and ``symbol``, ``date``, ``hour`` to read only these partitions; ``pushdown`` (``true``) to have them taken
from the query's own filters.
"""

from __future__ import annotations

import gzip
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from seqlake.sources import columnar
from seqlake.sources.records import Record, header, packed, read_rows, read_version
from seqlake.sources.records import VERSION as ROWS_VERSION
from seqlake.sources.store import SUFFIX, Store, Taken, valid_symbol, window_keys

PLACE = "symbol string, date string, hour string, file string, file_idx int, rec long"
RECORDS = f"{PLACE}, kind string, recv_ns long, raw binary, expected decimal(20,0), got decimal(20,0), dropped decimal(20,0), reason string"
INDEX = f"{PLACE}, type string, exch_ns long, seq decimal(20,0), side string, price_text string, size_text string"
FOOTERS = "symbol string, date string, hour string, file string, file_idx int, batch int, rec long, rows long, first_ns long, last_ns long, has_gap boolean, has_reseed boolean"
PROFILE = "symbol string, date string, hour string, file string, file_idx int, version int, stored long, batches long, rows long, gap_batches long, bytes long, framing long, frame_bytes long, columns array<struct<name:string,raw:long,stored:long>>"
SCHEMAS = {"records": RECORDS, "index": INDEX, "footers": FOOTERS, "profile": PROFILE}
#: Fixed value: files of the first 10 bytes' version are these.
VERSIONS = (ROWS_VERSION, columnar.VERSION)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Nanoseconds from the year 1, from which windows are counted, to 1970.
ORIGIN = 62_135_596_800 * 10**9


def open_version(f: io.BufferedIOBase) -> int:
    version = read_version(f)
    if version not in VERSIONS:
        raise ValueError(f"version {version} is not known")
    return version


def read_records(f: io.BufferedIOBase) -> Iterator[Record]:
    """A file's records, whichever format its version says."""
    if open_version(f) == ROWS_VERSION:
        yield from read_rows(f)
    else:
        for body, footer in columnar.read_bodies(f):
            yield from columnar.decode_batch(body or b"", footer).records


def to_bytes(records: list[Record], version: int) -> bytes:
    """A whole file of records."""
    body = map(packed, records) if version == ROWS_VERSION else map(columnar.encode_batch, columnar.batches(iter(records)))
    return header(version) + b"".join(body)


def window_start(at_ns: int, window_ns: int) -> int:
    return at_ns - (at_ns + ORIGIN) % window_ns


def key_of(symbol: str, start_ns: int) -> str:
    """The object key of a symbol's file that starts at ``start_ns``."""
    at = EPOCH + timedelta(seconds=start_ns // 10**9)
    return f"v1/symbol={valid_symbol(symbol)}/date={at:%Y-%m-%d}/hour={at:%H}/{at:%Y%m%dT%H%M%SZ}{SUFFIX}"


@dataclass
class _File(InputPartition):
    index: int
    key: str
    parts: tuple


def parts_of(key: str) -> tuple:
    """symbol, date and hour that a key names, null where it doesn't."""
    named = dict(p.split("=", 1) for p in key.split("/") if "=" in p)
    return tuple(named.get(k) for k in ("symbol", "date", "hour"))


class TapeReader(DataSourceReader):
    """One task for each file; a file's place is its index among its symbol's files."""

    def __init__(self, root: str, mode: str, wanted: dict[str, set[str]]):
        self.root, self.mode, self.wanted = root, mode, wanted

    def partitions(self) -> list[InputPartition]:
        store = Store(self.root)
        if store.is_file():
            name = store.base.rpartition("/")[2]
            return [_File(0, name, parts_of(store.base))]
        out, counts = [], {}
        for key in window_keys(store):
            parts = parts_of(key)
            index = counts[parts[0]] = counts.get(parts[0], -1) + 1  # a file keeps its place whatever is read beside it
            if all(parts[i] in self.wanted[n] for i, n in enumerate(("symbol", "date", "hour")) if n in self.wanted):
                out.append(_File(index, key, parts))
        if not out:
            raise FileNotFoundError(f"{self.root} holds no {SUFFIX} file of {self.wanted}")
        return out

    def read(self, partition: _File) -> Iterator[tuple]:
        store = Store(self.root)
        key = "" if store.is_file() else partition.key
        place = (*partition.parts, partition.key, partition.index)
        wide = lambda v: None if v is None else Decimal(v)
        with store.open(key) as raw, io.BufferedReader(raw, 1 << 18) as f:
            if self.mode == "records":
                for rec, r in enumerate(read_records(f)):
                    kind, at, frame, *numbers, reason = r.row()
                    yield *place, rec, kind, at, frame, *map(wide, numbers), reason
                return
            version = open_version(f)
            if self.mode == "profile":
                size = store.size(key)
                if version == ROWS_VERSION:  # measured as the columnar file that it would be
                    f = io.BytesIO(to_bytes(list(read_rows(f)), columnar.VERSION))
                    f.seek(8)
                p = columnar.profile(f)
                yield *place, version, size, *[p[k] for k in ("batches", "rows", "gap_batches", "bytes", "framing", "frame_bytes")], [(n, a, b) for n, (a, b) in p["columns"].items()]
                return
            if version == ROWS_VERSION:
                raise ValueError(f"{partition.key} is row-oriented: it has no {self.mode}")
            rec = 0
            for number, (body, footer) in enumerate(columnar.read_bodies(f, skip=self.mode == "footers")):
                if self.mode == "footers":
                    yield *place, number, rec, footer.rows, footer.first_ns, footer.last_ns, footer.has_gap, footer.has_reseed
                else:
                    index = columnar.decode_batch(body or b"", footer).index
                    for i, row in enumerate(zip(*[index[k] for k in ("type", "exch_ns", "seq", "side", "price_text", "size_text")], strict=True)):
                        yield *place, rec + i, row[0], row[1], wide(row[2]), *row[3:]
                rec += footer.rows


class PruningReader(TapeReader):
    """The reader that takes filters; Spark wants ``spark.sql.python.filterPushdown.enabled`` for it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on symbol, date and hour choose files; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else ""
            if name not in ("symbol", "date", "hour"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class TapeWriter(DataSourceWriter):
    """Rows (``symbol, kind, recv_ns, raw, expected, got, dropped, reason``) as one file for each symbol and window.

    A window's rows must come in one task and in one run (``repartition("symbol", window).sortWithinPartitions(...)``): a
    window that comes again after it was closed is refused, and so is a key that is taken. Files appear when all tasks are done.
    """

    def __init__(self, root: str, version: int, window_ns: int, columns: list[str]):
        if window_ns <= 0 or version not in VERSIONS:
            raise ValueError(f"a window of {window_ns} ns in version {version}")
        self.root, self.version, self.window_ns, self.columns = root, version, window_ns, columns

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, done, files = Store(self.root), set(), []
        get = {c: i for i, c in enumerate(self.columns)}

        def record(row) -> Record:
            value = lambda c: row[get[c]] if c in get else None
            return Record(value("kind"), value("recv_ns"), bytes(value("raw") or b""), *[int(value(c) or 0) for c in ("expected", "got", "dropped")], value("reason") or "")

        window = lambda row: (row[get["symbol"]], window_start(row[get["recv_ns"]], self.window_ns))
        for (symbol, start), rows in itertools.groupby(iterator, key=window):
            key = key_of(symbol, start)
            if key in done:
                raise Taken(f"{key} was closed before")
            done.add(key)
            files.append((store.stage(to_bytes([record(r) for r in rows], self.version)), key))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store = Store(self.root)
        files = sorted((x for m in messages if m for x in m.files), key=lambda x: x[1])
        keys = [k for _, k in files]
        taken = {k for k in keys if store.is_file(k)} | {a for a, b in zip(keys, keys[1:], strict=False) if a == b}
        if taken:
            self.abort(messages)
            raise Taken(", ".join(sorted(taken)))
        for staged, key in files:
            store.place(staged, key)

    def abort(self, messages: list[_Written | None]) -> None:
        store = Store(self.root)
        for m in messages:
            for staged, _ in m.files if m else ():
                store.drop(staged)


class TapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tapelog"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "records")]

    def reader(self, schema) -> DataSourceReader:
        wanted = {k: {self.options[k]} for k in ("symbol", "date", "hour") if self.options.get(k)}
        kind = PruningReader if self.options.get("pushdown") == "true" else TapeReader
        return kind(self.options["path"], self.options.get("mode", "records"), wanted)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("stored records are never rewritten: use mode append")
        return TapeWriter(self.options["path"], int(self.options.get("version", columnar.VERSION)), int(self.options.get("window_ns", 300 * 10**9)), schema.fieldNames())


def transcode(source: Store, target: Store, version: int = columnar.VERSION) -> list[str]:
    """Every window file of ``source`` as a file of ``version`` under the same key in ``target``; the keys. Files of a key that is taken are refused."""
    keys = window_keys(source)
    for key in keys:
        with source.open(key) as raw, io.BufferedReader(raw, 1 << 18) as f:
            target.put(key, to_bytes(list(read_records(f)), version))
    return keys


def materialize(packed: Store, target: Store) -> list[str]:
    """Window files that are kept gzipped (``.tape.gz``), unpacked under their keys; the keys."""
    keys = [k for k in packed.list() if k.endswith(f"{SUFFIX}.gz")]
    for key in keys:
        with packed.open(key) as raw:
            target.put(key.removesuffix(".gz"), gzip.decompress(raw.read()))
    return [k.removesuffix(".gz") for k in keys]
