"""Edits of data sources in the order in which they were made, whatever their kinds.

An edit turns the state of a source (there or not, type, element) into another. What a run of edits does
is a table from the states it may meet to the states it leaves, with one entry for all elements that the
run does not name. Edits are dealt out by ranges of (path, seq); a task folds each run into its table, so
a source with very many edits is split, and sends one table from each task. The tables of a source, in
order, are then looked up one after the other.

Saving an element also frees sources that are not named. Only sources that may be on the element can
notice: for each time that one is put there, the next save of the element is all that matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefuse.schemas import ASSOCIATION_TYPES
from kinefuse.shipping import ship
from kinefuse.storage import write_and_read

# Kinds of edits.
KINDS = ("add", "delete", "toggle", "set", "request", "save")
EDITS = "path string, seq long, kind string, element_id string, new_type string, paths array<string>"

#: Puts and saves of one element that meet in a task, about.
NEXT_ROWS = 50_000

#: Stands for any element that a run does not name, and for any type that is not known.
_ANY = object()
_OTHER = "?"
State = tuple[bool, str | None, object]


def step(state: State, kind: str, element: str | None, new_type: str | None) -> State:
    """The state after one edit. `put` and `drop` are what a save does to the sources it names and to others."""
    there, association, on = state
    if not there:
        return (True, new_type if new_type in ASSOCIATION_TYPES else ASSOCIATION_TYPES[0], None) if kind == "add" else state
    if kind == "delete":
        return (False, None, None)
    if kind == "toggle":
        return (True, "LOCAL" if association == "GLOBAL" else "GLOBAL", None)
    if kind == "set":
        return (True, new_type, None) if new_type in ASSOCIATION_TYPES else state
    if kind == "request":
        return (True, "LOCAL", element) if on in (None, "") and element is not None else state
    if kind == "put":
        return state if on == element else (True, "LOCAL", element)
    if kind == "drop":
        return (True, association, None) if on == element else state
    return state


class Run:
    """What a run of edits does to each state it may meet."""

    def __init__(self, types: tuple[str, ...] = (*ASSOCIATION_TYPES, _OTHER)):
        self.types = types
        self.states: list[State] = [(False, None, None)]
        self.cases: dict[tuple[str | None, object], int] = {(None, None): 0}
        for association in types:
            for element in (None, "", _ANY):
                self.cases[association, element] = len(self.states)
                self.states.append((True, association, element))

    def add(self, kind: str, element: str | None, new_type: str | None) -> None:
        if element is not None:
            self._name(element)
        after = [step(s, kind, element, new_type) for s in self.states]
        numbers = {s: k for k, s in enumerate(dict.fromkeys(after))}
        if len(numbers) < len(after):
            self.cases = {case: numbers[after[k]] for case, k in self.cases.items()}
            after = list(numbers)
        self.states = after

    def _name(self, element: str) -> None:
        """A case of its own for an element: so far it went the way of all that were not named."""
        if (self.types[0], element) in self.cases:
            return
        for association in self.types:
            there, kind, on = self.states[self.cases[association, _ANY]]
            self.cases[association, element] = len(self.states)
            self.states.append((there, kind, element if on is _ANY else on))

    def table(self) -> list[tuple[str, dict]]:
        return [(_case(*case), _outcome(self.states[k])) for case, k in self.cases.items()]


def _case(association: str | None, element: object) -> str:
    if association is None:
        return ""
    return f"{association}*" if element is _ANY else f"{association}-" if element is None else f"{association}={element}"


def _outcome(state: State) -> dict:
    there, association, element = state
    return {"there": there, "association": association, "element": None if element is _ANY else element, "stays": element is _ANY}


_OUTCOME = pa.struct([("there", pa.bool_()), ("association", pa.string()), ("element", pa.string()), ("stays", pa.bool_())])
FOLDED = "path string, seq long, cases map<string, struct<there: boolean, association: string, element: string, stays: boolean>>"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table for each path of a sorted partition; seq is that of its first edit."""
    path, first, run = None, None, None

    def folded() -> pa.RecordBatch:
        cases = pa.array([run.table()], pa.map_(pa.string(), _OUTCOME))
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([first], pa.int64()), cases], ["path", "seq", "cases"])

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("path", "seq", "kind", "element_id", "new_type"))
        for at, seq, kind, element, new_type in zip(*columns, strict=True):
            if run is None or at != path:
                if run is not None:
                    yield folded()
                path, first, run = at, seq, Run()
            run.add(kind, element, new_type)
    if run is not None:
        yield folded()


def _next_saves(puts: DataFrame, saves: DataFrame) -> DataFrame:
    """puts (path, element_id, seq) with the next save of the element after each as `seq`; those without one are left out.

    Times are cut into buckets, so an element with very many puts and saves meets in many tasks.
    """
    marks = puts.select("path", "element_id", "seq", F.lit(False).alias("saved")).unionByName(
        saves.select(F.lit(None).cast("string").alias("path"), "element_id", "seq", F.lit(True).alias("saved")).distinct()
    )
    marks = write_and_read(marks, "puts-and-saves")
    first, last, count = marks.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    width = max(1, ((last or 0) - (first or 0)) // max(1, count // NEXT_ROWS) + 1)
    cut = marks.withColumn("bucket", F.expr(f"seq div {width}"))
    save = F.when(F.col("saved"), F.col("seq"))
    later = Window.partitionBy("element_id", "bucket").orderBy(F.col("seq").desc()).rangeBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("soon", F.min(save).over(later)).where("NOT saved")
    firsts = cut.groupBy("element_id", "bucket").agg(F.min(save).alias("least"))
    beyond = Window.partitionBy("element_id").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("element_id", "bucket", F.min("least").over(beyond).alias("late"))
    found = inside.join(firsts, ["element_id", "bucket"]).select("path", "element_id", F.coalesce("soon", "late").alias("seq"))
    return found.where("seq IS NOT NULL").distinct()


def source_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of each source (path, seq, kind, element_id, new_type), saves as `put` and `drop`."""
    named = edits.withColumn("new_type", F.upper("new_type"))
    own = named.where(F.col("kind").isin(*[k for k in KINDS if k != "save"]) & F.col("path").isNotNull()).select("path", "seq", "kind", "element_id", "new_type")
    saves = edits.where("kind = 'save' AND element_id IS NOT NULL").select("element_id", "seq", "paths")
    nothing = F.lit(None).cast("string")
    put = write_and_read(saves.select(F.explode("paths").alias("path"), "seq", "element_id").where("path IS NOT NULL").distinct(), "puts")
    asked = own.where("kind = 'request' AND element_id IS NOT NULL").select("path", "seq", "element_id")
    times = saves.select("element_id", "seq")
    begun = sources.where("associated_element_id IS NOT NULL").select("path", F.col("associated_element_id").alias("element_id"))
    # A source that begins on an element notices its first save.
    freed = begun.join(times.groupBy("element_id").agg(F.min("seq").alias("seq")), "element_id").select("path", "element_id", "seq")
    freed = freed.unionByName(_next_saves(put.unionByName(asked), times)).join(put, ["path", "element_id", "seq"], "left_anti")
    by_save = put.withColumn("kind", F.lit("put")).unionByName(freed.withColumn("kind", F.lit("drop")))
    return own.unionByName(by_save.withColumn("new_type", nothing))


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Sources after all edits, in the order of `seq`.

    edits (see EDITS): add (a source that is not there; new_type or UNASSOCIATED), delete, toggle, set (new_type; unknown types change nothing),
    request (an element for a source that has none), save (element_id gets exactly `paths`). Edits of one source with one seq go by kind,
    element and type. Edits of sources that are not there change nothing, but for add. Added sources have null in the other columns of `sources`.
    """
    ship(sources.sparkSession)
    ranged = ("path", "seq", "kind", "element_id", "new_type")
    events = write_and_read(source_edits(sources, edits), "source-edits")
    folded = events.repartitionByRange(*ranged).sortWithinPartitions(*ranged).mapInArrow(_fold, FOLDED)
    # A path has one table from each task that holds a range of its edits.
    runs = folded.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", F.map_entries("cases").alias("cases")))).alias("runs"))
    joined = sources.withColumn("_there", F.lit(True)).join(runs, "path", "full")
    start = F.struct(
        F.coalesce("_there", F.lit(False)).alias("there"), F.col("association_type").alias("association"), F.col("associated_element_id").alias("element")
    )
    none = F.array().cast("array<struct<seq: bigint, cases: array<struct<key: string, value: struct<there: boolean, association: string, element: string, stays: boolean>>>>>")
    ends = F.aggregate(F.coalesce("runs", none), start, lambda state, run: _looked_up(state, F.map_from_entries(run["cases"])))
    after = joined.withColumn("_state", ends).where("_state.there")
    changed = {"association_type": F.col("_state.association"), "associated_element_id": F.col("_state.element")}
    return after.withColumns(changed).select(*sources.columns)


def _looked_up(state: Column, cases: Column) -> Column:
    known, element = state["association"].isin(*ASSOCIATION_TYPES), state["element"]
    association = F.when(known, state["association"]).otherwise(_OTHER)
    case = F.when(~state["there"], F.lit("")).when(element.isNull(), F.concat(association, F.lit("-"))).otherwise(F.concat(association, F.lit("="), element))
    found = F.coalesce(F.try_element_at(cases, case), F.try_element_at(cases, F.concat(association, F.lit("*"))))
    return F.when(
        found.isNotNull(),
        F.struct(
            found["there"].alias("there"),
            F.when(found["association"] == _OTHER, state["association"]).otherwise(found["association"]).alias("association"),
            F.when(found["stays"], element).otherwise(found["element"]).alias("element"),
        ),
    ).otherwise(state)
