"""Declarative metric layer: named metrics, dimensions and filters become one DataFrame.

A request names metrics, dimensions and filters. Every metric is aggregated on its own
table; a dimension of another table is joined along relationships that are proven many-to-one
(or one-to-one), any number of them, so a join can never multiply the rows behind a metric.
Before such a join the metric's table is reduced to partial sums per foreign key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spindrift.functions.numeric import ratio, round_half_up
from spindrift.sources import parameters as P


class SemanticError(ValueError):
    """A request that the model cannot answer without guessing or fanning out."""


@dataclass(frozen=True)
class Dimension:
    expr: str
    synonyms: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    unique: bool = False
    is_time: bool = False


@dataclass(frozen=True)
class Metric:
    """``kind`` is count, sum, avg or count_distinct; ``expr`` is its argument."""

    kind: str
    expr: str = "1"
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class LogicalTable:
    key: str
    dimensions: Mapping[str, Dimension]
    metrics: Mapping[str, Metric]
    facts: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    filters: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Relationship:
    child: str
    parent: str
    column: str
    one_to_one: bool = False


@dataclass(frozen=True)
class Model:
    tables: Mapping[str, LogicalTable]
    relationships: tuple[Relationship, ...]

    def steps(self, table: str) -> list[tuple[str, str]]:
        """(table, column) one join away that adds no rows: at most one row there has the column's value.

        A relationship leads from the child to the parent, and back if it is one to one. Either way
        the column must be the key of the table it leads to, or declared unique there.
        """
        found = [(r.parent, r.column) for r in self.relationships if r.child == table]
        found += [(r.child, r.column) for r in self.relationships if r.parent == table and r.one_to_one]
        return [(t, c) for t, c in found if self.is_unique(t, c)]

    def is_unique(self, table: str, column: str) -> bool:
        known = self.tables[table]
        return column == known.key or any(d.unique and d.expr == column for d in known.dimensions.values())

    def path(self, table: str, target: str) -> list[tuple[str, str, str]]:
        """The joins (from, to, column) of the one shortest way that multiplies no row of ``table``."""
        ways: dict[str, list[list[tuple[str, str, str]]]] = {table: [[]]}
        frontier = [table]
        while frontier and target not in ways:
            reached: dict[str, list[list[tuple[str, str, str]]]] = {}
            for at in frontier:
                for to, column in self.steps(at):
                    if to not in ways:
                        reached.setdefault(to, []).extend([*way, (at, to, column)] for way in ways[at])
            ways |= reached
            frontier = list(reached)
        if target not in ways:
            raise SemanticError(f"{target} would multiply the rows of {table}: {self._fan_out(table, target)}")
        if len(ways[target]) > 1:
            named = " or ".join(" -> ".join([table, *(to for _, to, _ in way)]) for way in ways[target])
            raise SemanticError(f"more than one way from {table} to {target}: {named}")
        return ways[target][0]

    def _fan_out(self, table: str, target: str) -> str:
        """The first step towards ``target`` that is one to many, or that there is no way at all."""
        seen, frontier = {table}, [(table, "")]
        while frontier:
            at, blame = frontier.pop(0)
            if at == target:
                return blame
            for r in self.relationships:
                to = r.parent if r.child == at else r.child if r.parent == at else None
                if to and to not in seen:
                    seen.add(to)
                    many = (to, r.column) not in self.steps(at)
                    frontier.append((to, blame or (f"{at} -> {to} is one to many" if many else "")))
        return "no relationship leads there"

    def find(self, name: str, section: str, prefer: str | None = None) -> tuple[str, str]:
        """(table, canonical name) of a metric, dimension, fact or filter.

        Accepts ``table.name``, a canonical name or a synonym. A name that several tables
        offer is resolved to ``prefer`` if that is one of them, else it is an error.
        """
        wanted = name.lower()
        if "." in wanted:
            table, _, wanted = wanted.partition(".")
            prefer, scope = table, {table: self.tables[table]}
        else:
            scope = self.tables
        found = []
        for table_name, table in scope.items():
            entries = getattr(table, section)
            for canonical, entry in entries.items():
                words = entry if isinstance(entry, tuple) else getattr(entry, "synonyms", ())
                if wanted == canonical or wanted in words:
                    found.append((table_name, canonical))
        preferred = [f for f in found if f[0] == prefer]
        if len(preferred) == 1:
            return preferred[0]
        if len(found) == 1:
            return found[0]
        raise SemanticError(f"{'ambiguous' if found else 'unknown'} name in {section}: {name}")

    def validate(self, frames: Mapping[str, DataFrame]) -> None:
        """Resolve every expression of the model against the actual schemas (no job runs)."""
        for name, table in self.tables.items():
            exprs = [d.expr for d in table.dimensions.values()]
            exprs += [m.expr for m in table.metrics.values()] + list(table.facts) + list(table.filters.values())
            frames[name].select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(exprs)])


def exact(value: Column) -> Column:
    """As a decimal with 12 digits after the point, so that sums don't depend on their order."""
    return value.cast("decimal(38,12)")


def _partial(name: str, metric: Metric) -> dict[str, Column]:
    value = F.expr(metric.expr)
    if metric.kind == "count":
        return {f"{name}__n": F.count("*")}
    total = F.sum(exact(value))
    if metric.kind == "sum":
        return {f"{name}__s": total}
    return {f"{name}__s": total, f"{name}__n": F.count(value)}


def _final(name: str, metric: Metric) -> Column:
    if metric.kind == "count":
        return F.sum(f"{name}__n")
    if metric.kind == "count_distinct":
        return F.countDistinct(f"{name}__d")
    if metric.kind == "sum":
        return F.sum(f"{name}__s").cast("double")
    return ratio(F.sum(f"{name}__s"), F.sum(f"{name}__n"))


def _dimension_column(model: Model, table: str, name: str, grain: str | None) -> Column:
    dimension = model.tables[table].dimensions[name]
    column = F.expr(dimension.expr)
    if dimension.is_time and grain:
        return F.date_trunc(grain, column).cast("date")
    return column


def _predicate(model: Model, spec, prefer: str) -> tuple[str, Column]:
    """A named filter, or (dimension, value or list of values)."""
    if isinstance(spec, str):
        table, name = model.find(spec, "filters", prefer)
        return table, F.expr(model.tables[table].filters[name])
    name, value = spec
    table, canonical = model.find(name, "dimensions", prefer)
    column = F.expr(model.tables[table].dimensions[canonical].expr)
    values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    return table, column.isin(*values)


def _one_table(model, frames, table, metrics, dimensions, filters, grain) -> DataFrame:
    """Aggregate the metrics of one table by the requested dimensions.

    Tables that dimensions or filters need are joined along ``Model.path``, one after another, to
    partial sums by the foreign keys of the first joins.
    """
    local: dict[str, Column] = {}
    remote: dict[str, dict[str, Column]] = {}
    for output, name in dimensions.items():
        owner, canonical = model.find(name, "dimensions", table)
        column = _dimension_column(model, owner, canonical, grain)
        (local if owner == table else remote.setdefault(owner, {}))[output] = column
    base, parent_filters = frames[table], {}
    for spec in filters:
        owner, predicate = _predicate(model, spec, table)
        if owner == table:
            base = base.where(predicate)
        else:
            parent_filters[owner] = parent_filters[owner] & predicate if owner in parent_filters else predicate
    joins: dict[str, tuple[str, str]] = {}
    for owner in sorted(set(remote) | set(parent_filters)):
        for at, to, column in model.path(table, owner):
            if joins.setdefault(to, (at, column)) != (at, column):
                raise SemanticError(f"{to} is needed over {joins[to][0]} and over {at}")
    distincts = {f"{n}__d": F.expr(m.expr) for n, m in metrics.items() if m.kind == "count_distinct"}
    keys = {f"_{table}_{column}": F.col(column) for at, column in joins.values() if at == table}
    partials = {k: v for n, m in metrics.items() if m.kind != "count_distinct" for k, v in _partial(n, m).items()}
    group = [c.alias(n) for n, c in {**keys, **local, **distincts}.items()]
    # count("*") keeps the aggregation valid when only distinct counts are asked for
    reduced = base.groupBy(*group).agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in partials.items()])
    for to, (at, column) in _nearest_first(joins, table):
        side = frames[to]
        if to in parent_filters:
            side = side.where(parent_filters[to])
        columns = [c.alias(n) for n, c in remote.get(to, {}).items()]
        onward = {f"_{to}_{c}": F.col(c) for a, c in joins.values() if a == to}
        side = side.select(F.col(column).alias("_on"), *columns, *[c.alias(n) for n, c in onward.items()])
        # a table that filters drops the rest; otherwise rows without a match keep NULLs
        how = "inner" if to in parent_filters else "left"
        reduced = reduced.join(side, F.col(f"_{at}_{column}") == F.col("_on"), how).drop("_on")
    return reduced.groupBy(*dimensions).agg(*[_final(n, m).alias(n) for n, m in metrics.items()])


def _nearest_first(joins: Mapping[str, tuple[str, str]], table: str) -> list[tuple[str, tuple[str, str]]]:
    """Joins in an order in which the table that a join starts from is there already."""
    done, ordered = {table}, []
    while len(ordered) < len(joins):
        ready = [(to, j) for to, j in joins.items() if to not in done and j[0] in done]
        ordered += ready
        done |= {to for to, _ in ready}
    return ordered


def compile_request(
    model: Model,
    frames: Mapping[str, DataFrame],
    metrics: Sequence[str],
    dimensions: Sequence[str] = (),
    filters: Sequence = (),
    grain: str | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
    digits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Answer a metric request. ``order_by`` entries starting with ``-`` sort descending;
    the dimensions are appended as tiebreak, so a limited result is well defined."""
    prefer = None
    by_table: dict[str, dict[str, Metric]] = {}
    for name in metrics:
        table, canonical = model.find(name, "metrics", prefer)
        prefer = prefer or table
        by_table.setdefault(table, {})[canonical] = model.tables[table].metrics[canonical]
    outputs = {model.find(d, "dimensions", prefer)[1]: d for d in dimensions}
    results = [
        _one_table(model, frames, table, chosen, outputs, filters, grain) for table, chosen in by_table.items()
    ]
    answer = results[0]
    if len(results) > 1:
        # one row per table and group; NULL-safe on the dimensions, no join needed
        for other in results[1:]:
            answer = answer.unionByName(other, allowMissingColumns=True)
        names = [m for chosen in by_table.values() for m in chosen]
        answer = answer.groupBy(*outputs).agg(*[F.max(m).alias(m) for m in names])
    for name, places in (digits or {}).items():
        answer = answer.withColumn(name, round_half_up(F.col(name), places))
    if order_by or limit is not None:
        keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order_by]
        answer = answer.orderBy(*keys, *outputs)
    return answer if limit is None else answer.limit(limit)


def listing(
    model: Model,
    frames: Mapping[str, DataFrame],
    table: str,
    columns: Sequence[str],
    order_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Row-level request: dimensions and facts of one table, without aggregation."""
    known = model.tables[table]
    picked = []
    for name in columns:
        section = "dimensions" if name in known.dimensions else "facts"
        _, canonical = model.find(f"{table}.{name}", section)
        picked.append(F.expr(known.dimensions[canonical].expr if section == "dimensions" else canonical).alias(canonical))
    rows = frames[table].select(*picked)
    if order_by:
        rows = rows.orderBy(*[F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order_by], known.key)
    return rows if limit is None else rows.limit(limit)


def enum_violations(model: Model, frames: Mapping[str, DataFrame], table: str) -> DataFrame:
    """Values outside a dimension's declared list."""
    from spindrift.sources.schemas import unlisted_values

    enums = {d.expr: d.values for d in model.tables[table].dimensions.values() if d.values}
    return unlisted_values(frames[table], enums)


def data_checks(model: Model, frames: Mapping[str, DataFrame], table: str) -> DataFrame:
    """What a table breaks of its declaration: ``table_name``, ``column_name``, ``check``, ``n_rows``.

    ``listed``: rows whose value is not in the dimension's list; ``present``: rows without a value in
    a declared column; ``unique``: rows beyond the first of a value that is declared unique (the key,
    too). One pass does it all: the counts are observed while the values of the unique columns, as
    (column, hash) rows, are counted.
    """
    known = model.tables[table]
    enums = {d.expr: d.values for d in known.dimensions.values() if d.values}
    declared = list(dict.fromkeys(d.expr for d in known.dimensions.values()))
    single = [d.expr for d in known.dimensions.values() if d.unique]
    if known.key in frames[table].columns:
        single = list(dict.fromkeys([known.key, *single]))
    seen = Observation(f"checks of {table}")
    counts = [F.count_if(~F.expr(e).cast("string").isin(*values)).alias(f"listed:{e}") for e, values in enums.items()]
    counts += [F.count_if(F.expr(e).isNull()).alias(f"present:{e}") for e in declared]
    observed = frames[table].observe(seen, F.count("*").alias("rows"), *counts)
    repeated: dict[str, int] = {}
    if frames[table].isEmpty():
        # Spark drops an empty plan together with what it should observe
        metrics = {f"listed:{e}": 0 for e in enums} | {f"present:{e}": 0 for e in declared}
    elif not single:
        observed.agg(F.count("*")).collect()
        metrics = seen.get
    else:
        cells = F.array(*[F.struct(F.lit(e).alias("column_name"), F.expr(e).cast("string").alias("value")) for e in single])
        values = observed.select(F.explode(cells).alias("c")).where("c.value is not null")
        # 96 bits of hash stand for a value, so that wide values are not shuffled
        per_value = values.groupBy("c.column_name", F.xxhash64("c.value").alias("h1"), F.hash("c.value").alias("h2")).agg(F.count("*").alias("n"))
        repeated = {r["column_name"]: r["n"] for r in per_value.groupBy("column_name").agg(F.sum(F.col("n") - 1).alias("n")).collect()}
        metrics = seen.get
    found = [(table, *name.split(":", 1)[::-1], n) for name, n in metrics.items() if name != "rows"]
    found += [(table, e, "unique", repeated.get(e, 0)) for e in single]
    spark = frames[table].sparkSession
    return spark.createDataFrame(found, "table_name string, column_name string, check string, n_rows long")


# fixed values: names and synonyms of the model
_MEMBER_DIMENSIONS = {
    "member_id": Dimension("member_id", unique=True),
    "gender": Dimension("gender", values=P.GENDERS),
    "membership_tier": Dimension("membership_tier", ("tier", "loyalty tier", "casino tier"), P.TIERS),
    "home_state": Dimension("home_state", ("state", "residence state")),
    "risk_appetite": Dimension("risk_appetite", ("risk level", "risk profile"), P.RISKS),
    "marital_status": Dimension("marital_status", values=P.MARITAL),
    "income_bracket": Dimension("income_bracket", ("income", "income range"), P.INCOMES),
}

MODEL = Model(
    tables={
        "members": LogicalTable(
            key="member_id",
            dimensions={
                **_MEMBER_DIMENSIONS,
                "enrollment_date": Dimension("enrollment_date", ("signup date", "join date"), is_time=True),
            },
            facts={
                "age": (),
                "total_cruises": ("cruises", "number of cruises"),
                "lifetime_spend": ("total spend", "lifetime spending"),
            },
            metrics={
                "total_members": Metric("count", synonyms=("member count", "number of members")),
                "avg_age": Metric("avg", "age"),
                "avg_lifetime_spend": Metric("avg", "lifetime_spend"),
            },
        ),
        "plays": LogicalTable(
            key="play_id",
            dimensions={
                "member_id": Dimension("member_id"),
                "ship_name": Dimension("ship_name", ("ship", "cruise ship", "vessel"), P.SHIPS),
                "denomination": Dimension("denomination", ("denom", "slot denomination", "machine denomination")),
                "game_name": Dimension("game_name", ("game", "slot game", "machine name")),
                "game_type": Dimension("game_type", ("machine type", "slot type")),
                "time_of_day": Dimension("time_of_day", ("session time", "play time"), P.TIMES_OF_DAY),
                "play_date": Dimension("play_date", ("session date", "date played"), is_time=True),
            },
            facts={
                "num_spins": ("spins", "number of spins"),
                "bet_per_spin": ("bet amount", "wager per spin"),
                "total_wagered": ("amount wagered", "total bet"),
                "total_won": ("winnings", "amount won"),
                "net_result": ("profit", "win/loss", "net win"),
                "session_duration_mins": ("duration", "session length", "play time minutes"),
            },
            metrics={
                "total_sessions": Metric("count", synonyms=("session count", "number of sessions")),
                "total_amount_wagered": Metric(
                    "sum", "total_wagered", ("total revenue", "gross gaming revenue")
                ),
                "total_amount_won": Metric("sum", "total_won"),
                "avg_bet": Metric("avg", "bet_per_spin", ("average bet", "mean bet")),
                "total_spins": Metric("sum", "num_spins"),
                "unique_players": Metric("count_distinct", "member_id"),
                "avg_session_duration": Metric("avg", "session_duration_mins"),
            },
            filters={"high_denomination": "denomination >= 5.00", "penny_slots": "denomination = 0.01"},
        ),
        "features": LogicalTable(
            key="member_id",
            dimensions={
                # no synonyms here: "tier" and the like always mean the member table
                **{k: Dimension(v.expr, unique=v.unique) for k, v in _MEMBER_DIMENSIONS.items()},
                "preferred_denomination": Dimension(
                    "preferred_denomination", ("favorite denomination", "preferred denom")
                ),
                "preferred_game_type": Dimension("preferred_game_type"),
                "preferred_game": Dimension("preferred_game", ("favorite game",)),
                "preferred_time_of_day": Dimension("preferred_time_of_day"),
                "most_played_ship": Dimension("most_played_ship", ("favorite ship",)),
            },
            facts={
                "age": (),
                "total_cruises": (),
                "lifetime_spend": (),
                "membership_days": (),
                "total_sessions": (),
                "total_spins": (),
                "avg_bet_per_spin": (),
                "total_wagered": (),
                "total_won": (),
                "net_result": (),
                "avg_session_duration": (),
                "win_rate_pct": ("win rate", "return percentage"),
                "ships_played": (),
                "games_played": (),
                "denominations_played": (),
            },
            metrics={
                "member_count": Metric("count"),
                "avg_member_wagered": Metric("avg", "total_wagered"),
                "avg_win_rate": Metric("avg", "win_rate_pct"),
            },
        ),
    },
    relationships=(
        Relationship("plays", "members", "member_id"),
        Relationship("features", "members", "member_id", one_to_one=True),
    ),
)

# Named reports with a verified meaning; aliases keep the second wording of the same question.
REPORTS = {
    "total_members_by_tier": dict(metrics=["total_members"], dimensions=["tier"], order_by=["-total_members"]),
    "top_games_by_revenue": dict(
        metrics=["total revenue"], dimensions=["game"], order_by=["-total_amount_wagered"], limit=5
    ),
    "avg_bet_by_denomination": dict(
        metrics=["avg_bet"], dimensions=["denom"], order_by=["denomination"], digits={"avg_bet": 2}
    ),
    "ship_revenue_comparison": dict(
        metrics=["gross gaming revenue"], dimensions=["ship"], order_by=["-total_amount_wagered"]
    ),
    "monthly_revenue_trend": dict(
        metrics=["total_amount_wagered", "unique_players"],
        dimensions=["session date"],
        grain="month",
        order_by=["play_date"],
    ),
    "top_games_by_sessions": dict(
        metrics=["total_sessions"], dimensions=["game_name"], order_by=["-total_sessions"], limit=10
    ),
}
ALIASES = {"total_revenue_by_ship": "ship_revenue_comparison", "member_count_by_tier": "total_members_by_tier"}


def report(name: str, frames: Mapping[str, DataFrame], model: Model = MODEL) -> DataFrame:
    if name == "high_value_members":
        columns = ["member_id", "total_wagered", "total_won", "win_rate_pct", "membership_tier", "preferred_denomination"]
        return listing(model, frames, "features", columns, ["-total_wagered"], 10)
    return compile_request(model, frames, **REPORTS[ALIASES.get(name, name)])
