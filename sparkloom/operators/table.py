"""Logical tables: a compact access syntax over one or several shards.

``t['a', {'k': 1}, this('b') > 3, 0:50:('~a',)]`` gives a lazy DataFrame; without a slice it stands for exactly one row and
gives a ``Row`` or raises :class:`NotFoundError`.  Writes give a new ``Table``; nothing changes in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.codecs import Codec, GroupCodec
from ..functions.expr import Expr, is_null
from ..plans import spec as S
from ..plans.cut import cut
from . import dml
from .dml import NotFoundError, NotInsertedError

SHARD = "_shard"


def hashed(name: str, n: int) -> Column:
    """The shard of a row by a hash of a column: '0' to 'n - 1'."""
    return F.pmod(F.xxhash64(name), F.lit(n)).cast("string")


class Table:
    """shards: key -> DataFrame (the keys order the shards).  ``splitter`` maps equality conditions (a dict, maybe empty) to the
    shard keys that rows with these values may lie in; an entry may also be (key, condition, ...), and these conditions then hold
    within that shard only.  Without a splitter every shard is visited.  ``codecs`` are by column, ``groups`` of several columns."""

    def __init__(self, shards: DataFrame | dict[str, DataFrame], key: list[str] = (), defaults: dict[str, Any] | None = None, splitter: Callable[[dict], Iterable] | None = None, codecs: dict[str, Codec] | None = None, groups: Iterable[GroupCodec] = (), whole: DataFrame | None = None):
        self.shards = shards if isinstance(shards, dict) else {"": shards}
        self.key, self.defaults, self.splitter, self.codecs, self.groups = list(key), defaults or {}, splitter, codecs or {}, tuple(groups)
        self.whole = whole  # all shards as one frame with their keys in _shard, if they are kept so

    @classmethod
    def by_column(cls, df: DataFrame, shard: Column, keys: Iterable[str], **how) -> Table:
        """One frame whose rows lie in the shards that a column says: read in one scan, and by shard as a filter on it.

        Rows that lie in none of these shards (or whose shard is NULL) are a shard of their own, the last, with the key None: they are
        read and changed with all others, and only rows of known shards can be added.
        """
        return cls._of_whole(df.withColumn(SHARD, shard.cast("string")), [*keys, None], **how)

    @classmethod
    def _of_whole(cls, whole: DataFrame, keys: Iterable[str | None], **how) -> Table:
        known = [k for k in keys if k is not None]
        shards = {k: whole.where(F.col(SHARD) == k).drop(SHARD) for k in known}
        if None in keys:
            shards[None] = whole.where(~F.coalesce(F.col(SHARD).isin(known), F.lit(False))).drop(SHARD)
        return cls(shards, whole=whole, **how)

    def save(self, path: str) -> None:
        """The stored rows in one folder for each shard (``_shard=key``), so that a reader opens the folders of its shards only."""
        self.stored().hint("rebalance", F.col(SHARD)).write.partitionBy(SHARD).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **how) -> Table:
        """What :meth:`save` wrote."""
        found = spark.read.parquet(path).schema
        found = T.StructType([T.StructField(f.name, T.StringType()) if f.name == SHARD else f for f in found])
        whole = spark.read.schema(found).parquet(path)
        keys = [r[0] for r in whole.select(SHARD).distinct().orderBy(SHARD).collect()]  # one row for each folder
        return cls._of_whole(whole, keys, **how)

    # reading

    def stored(self, keys: Iterable[str] | None = None, own: dict[str, tuple] | None = None) -> DataFrame:
        """The rows as they are stored, of some shards or all, with the shard's key when there are several.  own: conditions by
        shard."""
        own = {k: reduce(lambda a, b: a & b, [c.bare for c in v]) for k, v in (own or {}).items()}
        names = [k for k in self.shards if keys is None or k in set(keys)]
        if self.whole is not None:
            df = self.whole if keys is None else self.whole.where(self._lies_in(names))
            return df.where(reduce(lambda c, k: F.when(self._lies_in([k]), own[k]).otherwise(c), own, F.lit(True))) if own else df
        if not names:
            first = next(iter(self.shards.values()))
            names, parts = [], [first.where(F.lit(False))]
        else:
            parts = [self.shards[k].where(own[k]) if k in own else self.shards[k] for k in names]
        if len(self.shards) > 1:
            parts = [p.withColumn(SHARD, F.lit(k)) for p, k in zip(parts, names or [""], strict=True)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _lies_in(self, names: list[str | None]) -> Column:
        """Whether a row of the one frame lies in some of the shards."""
        known = [k for k in names if k is not None]
        hit = F.coalesce(F.col(SHARD).isin(known), F.lit(False)) if known else F.lit(False)
        if None not in names:
            return F.col(SHARD).isin(known) if known else hit
        return hit | ~F.coalesce(F.col(SHARD).isin([k for k in self.shards if k is not None]), F.lit(False))

    def df(self, keys: Iterable[str] | None = None) -> DataFrame:
        """The rows as users see them."""
        return self._decoded(self.stored(keys))

    def _decoded(self, df: DataFrame) -> DataFrame:
        for g in self.groups:
            df = df.withColumns(g.decoded()).drop(*g.stored)
        return df.withColumns({c: x.de(F.col(c)) for c, x in self.codecs.items()}) if self.codecs else df

    def pruned(self, equals: dict) -> tuple[list[str] | None, dict[str, tuple]]:
        """Shards that rows with these values can lie in (None: all), and conditions of single shards."""
        if self.splitter is None:
            return None, {}
        found = [x if isinstance(x, tuple) else (x,) for x in self.splitter(equals)]
        return [k for k, *_ in found], {k: tuple(own) for k, *own in found if own}

    def select(self, spec: S.QuerySpec) -> DataFrame:
        keys, own = self.pruned(spec.equals)
        if isinstance(spec.offset, dict):  # from the shard of a given row on
            at = self.pruned(spec.offset)[0] if self.splitter else list(self.shards)
            order = list(self.shards)
            first = min((order.index(k) for k in at), default=0)
            keys = [k for k in order[first:] if keys is None or k in keys]
            spec = S.QuerySpec(**{**spec.__dict__, "offset": 0})
        # equalities on coded columns are asked of the stored form, so they reach the scan
        df, done = self.stored(keys, own), set()
        for c, v in spec.equals.items():
            if c in self.codecs and not is_null(v):
                df = df.where(F.col(c) == self.codecs[c].en(F.lit(v) if not isinstance(v, (list, tuple)) else F.array(*map(F.lit, v))))
                done.add(c)
        for g in self.groups:
            if all(c in spec.equals and not is_null(spec.equals[c]) for c in g.inputs):
                for c, v in g.encoded(*[F.lit(spec.equals[c]) for c in g.inputs]).items():
                    df = df.where(F.col(c) == v)
                done |= set(g.inputs)
        return S.run(self._decoded(df), S.QuerySpec(**{**spec.__dict__, "equals": {c: v for c, v in spec.equals.items() if c not in done}}))

    def __getitem__(self, index: Any) -> DataFrame | Row:
        spec = S.parse(index)
        df = self.select(spec)
        if not spec.single:
            return df
        rows = df.limit(2).collect()
        if len(rows) != 1:
            raise NotFoundError(f"{'no row' if not rows else 'more than one row'} for {index!r}")
        return rows[0]

    def get(self, equals: dict, default: Any = None, columns: Iterable[str] = ()) -> Any:
        """One row for the condition, or the default."""
        rows = self.select(S.QuerySpec(columns=tuple(columns), equals=equals, single=False)).limit(1).collect()
        return rows[0] if rows else default

    def __rshift__(self, cond: dict) -> Row:
        """The one row for the conditions, whose values are also put into the dictionary; raises if there is none."""
        row = self.get(cond)
        if row is None:
            raise NotFoundError(f"no row for {cond!r}")
        cond.update(row.asDict())
        return row

    def gets(self, equals: dict, columns: Iterable[str] = (), limit: int | None = None, offset: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
        return self.select(S.QuerySpec(columns=tuple(columns), equals=equals, limit=limit, offset=offset, order=order, single=False))

    def found_rows(self, index: Any) -> DataFrame:
        """The number of rows that an access would give without its offset and limit, as one row."""
        spec = S.parse(index)
        return self.select(S.QuerySpec(**{**spec.__dict__, "limit": None, "offset": 0, "order": (), "single": False})).agg(F.count("*").alias("found_rows"))

    def group_per_shard(self, *aggs: Expr, by: tuple[str, ...]) -> DataFrame:
        """Groups counted shard by shard and not merged."""
        keys = [SHARD, *by] if len(self.shards) > 1 else list(by)
        return self.df().groupBy(*keys).agg(*[a.to_column() for a in aggs])

    def keys(self) -> list[str]:
        return S.visible(self.df())

    def __contains__(self, name: str) -> bool:
        return name in self.df().columns

    def __add__(self, other: Table) -> Table:
        """All rows of both."""
        mine = {f"a{k}": v for k, v in self.shards.items()}
        return Table(mine | {f"b{k}": v for k, v in other.shards.items()}, self.key, self.defaults, None, self.codecs, self.groups)

    def explain(self, index: Any) -> None:
        self.select(S.parse(index)).explain("formatted")

    # writing

    def _with(self, shards: dict[str, DataFrame] | DataFrame) -> Table:
        """The same table with other rows: by shard, or, of a table in one frame, as one frame with its shard column."""
        if isinstance(shards, DataFrame):
            return Table._of_whole(shards, list(self.shards), key=self.key, defaults=self.defaults, splitter=self.splitter, codecs=self.codecs, groups=self.groups)
        return Table(shards, self.key, self.defaults, self.splitter, self.codecs, self.groups)

    def _rows(self, rows: DataFrame | dict | list[dict]) -> DataFrame:
        if isinstance(rows, dict):
            rows = [rows]
        if not isinstance(rows, DataFrame):
            spark = SparkSession.getActiveSession()
            names = list(dict.fromkeys(k for r in rows for k in r))
            kinds = {f.name: f.dataType.simpleString() for f in self.df().schema}
            rows = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"`{k}` {kinds.get(k, 'string')}" for k in names))
        for g in self.groups:
            rows = rows.withColumns(g.encoded(*map(F.col, g.inputs))).drop(*g.inputs)
        return rows.withColumns({c: x.en(F.col(c)) for c, x in self.codecs.items() if c in rows.columns})

    def placed(self, rows: DataFrame, shard: Column) -> dict[str, DataFrame]:
        """Rows by shard; every row must lie in one of the shards."""
        return {k: rows.where(shard == k) for k in self.shards}

    def _each(self, rows: DataFrame, how, shard: Column | None) -> Table:
        """how(base, rows, key) by shard; of a table in one frame at once, the shard being part of the key."""
        if len(self.shards) == 1:
            (k, base), = self.shards.items()
            return self._with({k: how(base, rows, self.key)})
        if shard is None:
            raise dml.PlacementError("say by a column in which shard each row lies")
        known = [k for k in self.shards if k is not None]
        if not rows.where(~F.coalesce(shard.isin(known), F.lit(False))).isEmpty():
            raise dml.PlacementError("a row lies in no shard")
        if self.whole is not None:
            return self._with(how(self.whole, rows.withColumn(SHARD, shard.cast("string")), [SHARD, *self.key]))
        parts = self.placed(rows, shard)
        return self._with({k: how(base, parts[k], self.key) for k, base in self.shards.items()})

    def insert(self, rows, shard: Column | None = None) -> Table:
        return self._each(self._rows(rows), lambda b, r, key: dml.insert_ignore(b, r, key, self.defaults), shard)

    def extend(self, rows, shard: Column | None = None) -> tuple[Table, int]:
        """The table with the rows that are new, and how many these are: a count of the new rows alone."""
        return self._extended(self._rows(rows), shard)

    def _extended(self, rows: DataFrame, shard: Column | None) -> tuple[Table, int]:
        new = self._each(rows, lambda b, r, key: dml.new_rows(b, r, key, self.defaults), shard)
        return self._each(rows, lambda b, r, key: dml.insert_ignore(b, r, key, self.defaults), shard), new.stored().count()

    def append(self, row: dict, id_column: str | None = None, shard: Column | None = None) -> tuple[Table, Any]:
        """The table with one more row, and the row's id (its key, or a new number in ``id_column``); None if its key was there."""
        rows = self._rows(row)
        if id_column is not None and row.get(id_column) is None:
            rows = cut(dml.with_ids(self.stored(), rows.drop(id_column), id_column))
        name = id_column or (self.key[0] if self.key else None)
        (last,) = rows.select(name).collect()  # one row
        after, n = self._extended(rows, shard)
        return after, last[0] if n else None

    def __lshift__(self, row) -> Table:
        """The table with a row (or rows); raises if none is new."""
        after, n = self.extend(row)
        if not n:
            raise NotInsertedError("no row is new")
        return after

    def __iadd__(self, rows) -> Table:
        """The table with all rows; raises unless every one is new."""
        after, n = self.extend(rows)
        wanted = rows.count() if isinstance(rows, DataFrame) else len(rows)
        if n != wanted:
            raise NotInsertedError(f"{n} of {wanted} rows are new")
        return after

    def set(self, values: dict[str, Any], *where: Any) -> Table:
        """The table with changed rows; raises if there is none to change."""
        return _matched(*self.update(values, *where))

    def remove(self, *where: Any) -> Table:
        """The table without some rows; raises if there is none."""
        return _matched(*self.delete(*where))

    def upsert(self, rows, on_match: dict[str, Any], shard: Column | None = None) -> Table:
        return self._each(self._rows(rows), lambda b, r, key: dml.upsert(b, r, key, on_match, self.defaults), shard)

    def replace(self, rows, shard: Column | None = None) -> Table:
        return self._each(self._rows(rows), lambda b, r, key: dml.replace(b, r, key, self.defaults), shard)

    def update(self, values: dict[str, Any], *where: Any, limit: int | None = None) -> tuple[Table, DataFrame]:
        """The changed table, and its counts of matched and changed rows."""
        return self._change(lambda b, *how: dml.update(b, self._coded(values), *how), where, limit)

    def delete(self, *where: Any, limit: int | None = None) -> tuple[Table, DataFrame]:
        return self._change(dml.delete, where, limit)

    def clear(self) -> Table:
        if self.whole is not None:
            return self._with(self.whole.where(F.lit(False)))
        return self._with({k: b.where(F.lit(False)) for k, b in self.shards.items()})

    def _coded(self, values: dict[str, Any]) -> dict[str, Any]:
        """Values by stored column; of the columns of a group all or none must be given."""
        out = dict(values)
        for g in self.groups:
            given = [c for c in g.inputs if c in out]
            if given and len(given) < len(g.inputs):
                raise ValueError(f"{', '.join(g.inputs)} are stored together; give all of them")
            if given:
                cols = [v.bare if isinstance(v, Expr) else F.lit(None if is_null(v) else v) for v in (out.pop(c) for c in g.inputs)]
                out |= {c: Expr(v) for c, v in g.encoded(*cols).items()}
        return {c: Expr(self.codecs[c].en(F.lit(v))) if c in self.codecs and not isinstance(v, Expr) and not is_null(v) else v for c, v in out.items()}

    def _change(self, how, where, limit) -> tuple[Table, DataFrame]:
        """A limit goes on from shard to shard, in their order, and by key within one."""
        equals: dict = {}
        for w in where:
            if isinstance(w, dict):
                equals |= w
        keys, own = self.pruned(equals)
        visited = [k for k in self.shards if keys is None or k in keys]
        others = [w for w in where if not isinstance(w, dict)]
        if limit is not None and not self.key:
            raise ValueError("a limit needs a key")
        if self.whole is not None:
            return self._change_whole(how, equals, others, visited, own, limit)
        holds = {k: S.condition(self.shards[k], self._coded(equals), others + list(own.get(k, ()))) for k in visited}
        chosen = None
        if limit is not None and len(visited) > 1:
            hits = [dml.first_hits(self.shards[k], holds[k], limit, tuple(self.key)).withColumn("__shard", F.lit(i)) for i, k in enumerate(visited)]
            chosen = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits)
            chosen = chosen.orderBy("__shard", *S.ordering(tuple(self.key)), *S.ordering(tuple(c for c in self.shards[visited[0]].columns if c not in self.key))).limit(limit)
        done, counts = dict(self.shards), []
        for i, k in enumerate(visited):
            mine = None if chosen is None else chosen.where(F.col("__shard") == i).select(*self.shards[k].columns)
            out = how(self.shards[k], holds[k], limit, tuple(self.key), mine)
            done[k] = out.table
            counts.append(out.counts)
        if not counts:
            counts = [next(iter(self.shards.values())).limit(0).agg(F.count("*").alias("matched"), F.count("*").alias("changed"))]
        total = reduce(DataFrame.unionByName, counts).agg(F.sum("matched").alias("matched"), F.sum("changed").alias("changed"))
        return self._with(done), total

    def _change_whole(self, how, equals: dict, others: list, visited: list, own: dict[str, tuple], limit: int | None) -> tuple[Table, DataFrame]:
        """One change of the one frame, so that it stays one scan; rows of no known shard come last."""
        hold = S.condition(self.whole, self._coded(equals), others) & (self._lies_in(visited) if visited != list(self.shards) else F.lit(True))
        for k, conditions in own.items():
            hold = hold & F.when(self._lies_in([k]), reduce(lambda a, b: a & b, [c.bare for c in conditions])).otherwise(True)
        chosen = None
        if limit is not None:
            turn = F.array_position(F.array(*[F.lit(k) for k in self.shards if k is not None]), F.col(SHARD))
            turn = F.when(turn > 0, turn).otherwise(F.lit(1 << 40))
            chosen = dml.first_hits(self.whole.withColumn("__turn", turn), hold, limit, ("__turn", SHARD, *self.key)).drop("__turn")
        out = how(self.whole, hold, limit, (SHARD, *self.key), chosen)
        return self._with(out.table), out.counts


def _matched(table: Table, counts: DataFrame) -> Table:
    if not counts.first()["matched"]:
        raise NotFoundError("no row to change")
    return table


class DataBase:
    """Tables by name: ``db.orders``; ``by_name`` and ``by_function`` make logical tables of several physical ones."""

    def __init__(self, tables: dict[str, Table]):
        self._tables = tables

    def __getattr__(self, name: str) -> Table:
        try:
            return self._tables[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> Table:
        return self._tables[name]

    def keys(self) -> list[str]:
        return list(self._tables)

    @classmethod
    def by_function(cls, frames: dict[str, DataFrame], logical: Callable[[str], str], **how) -> DataBase:
        groups: dict[str, dict[str, DataFrame]] = {}
        for name, df in frames.items():
            groups.setdefault(logical(name), {})[name] = df
        return cls({name: Table(shards, **how) for name, shards in groups.items()})

    @classmethod
    def by_name(cls, frames: dict[str, DataFrame], **how) -> DataBase:
        return cls.by_function(frames, lambda n: n, **how)

    @staticmethod
    def databases(spark: SparkSession) -> list[str]:
        """Names of the catalogue's databases."""
        return [d.name for d in spark.catalog.listDatabases()]

    @staticmethod
    def tables(spark: SparkSession, database: str | None = None) -> list[str]:
        """Names of a database's base tables; views don't count."""
        return [t.name for t in spark.catalog.listTables(database) if t.tableType not in ("VIEW", "TEMPORARY") and not t.isTemporary]

    @classmethod
    def of_catalog(cls, spark: SparkSession, database: str | None = None, **how) -> DataBase:
        return cls.by_name({t.name: spark.table(t.name if database is None else f"{database}.{t.name}") for t in spark.catalog.listTables(database)}, **how)

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row for each column: table, ordinal, column, type."""
        rows = [(n, i, f.name, f.dataType.simpleString()) for n, t in self._tables.items() for i, f in enumerate(t.df().schema)]
        return spark.createDataFrame(rows, "table string, ordinal int, column string, type string")
