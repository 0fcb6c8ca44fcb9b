"""The forecast of one event end to end, from what has landed of it.

A stage says what an event's rows hold: ``post_quali`` a grid for nearly the whole field, ``pre_quali`` practice,
``pre_practice`` neither. Past events are scored out of sample as they stood at each stage, so a forecast's
temperatures come from events seen as its own is. Rows may hold several versions of an event (column ``version``):
each is staged, penalised and forecast by itself, all of them in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from ..constants import (
    DEFAULTS, EXPLANATION_GROUPS, GROUP_LABELS, MIN_CALIBRATION_EVENTS, PENALTY_GAP, PRACTICE_DETAIL_FEATURES, PRACTICE_FEATURES, QUALI_FEATURES, RACE_FEATURES,
)
from ..operators import ladders, listwise as lw, penalties as pen, projection as pj, ranker as rk
from ..session import cut
from ..sources.contest import EVENT, KEY, Tables
from . import evaluate as ev, features as ft

STAGES = ("post_quali", "pre_quali", "pre_practice")
AT = ["series", "race_seq", "version"]
RIDGE = 0.01
PRACTICE_FLAG = "practice_available"
#: What is not known before qualifying, and before practice.
GRID = ("grid", "grid_source", "quali_position", "quali_gap_to_pole_pct", "quali_gap_to_teammate_pct")
PRACTICE = tuple(c for c in (*PRACTICE_FEATURES, *PRACTICE_DETAIL_FEATURES, "sq_position") if c != PRACTICE_FLAG)
#: Fields smaller than this say nothing about a season's strength.
LEAST_FIELD = 5


@dataclass(frozen=True)
class Settings:
    recency: float = DEFAULTS["recency"]
    temperature: float = DEFAULTS["temperature"]
    quali_temperature: float = DEFAULTS["quali_temperature"]
    blend: float = DEFAULTS["blend"]
    sprint: float = DEFAULTS["sprint"]


def as_of(df: DataFrame, stage: str) -> DataFrame:
    """The rows of events as they stood at a stage."""
    if stage == "post_quali":
        return df
    early = stage == "pre_practice"
    return lw.without_columns(df, [*GRID, *(PRACTICE if early else ())], (PRACTICE_FLAG,) if early else ())


def versions(df: DataFrame, column: str) -> DataFrame:
    """The rows once for every stage, named in ``column``."""
    out = None
    for s in STAGES:
        one = as_of(df, s).withColumn(column, F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def stage_of(race: DataFrame) -> DataFrame:
    """(version of an event, stage, where its grid comes from): the stage is read off what the rows hold."""
    known = ladders.grid_known(race, AT)
    facts = race.groupBy(*AT).agg((F.max(PRACTICE_FLAG) > 0).alias("_practised"), F.mode("grid_source", True).alias("_source"))
    stage = F.when(F.col("known"), "post_quali").when(F.col("_practised"), "pre_quali").otherwise("pre_practice")
    source = F.when(F.col("known"), F.col("_source")).otherwise("projected")
    return known.join(facts, AT).select(*AT, stage.alias("stage"), source.alias("start_source"))


def projected(df: DataFrame, event: list[str]) -> DataFrame:
    """Rows before qualifying with the order that ``quali_score`` projects, in the columns' own types."""
    types = dict(df.dtypes)
    seen = lw.projected_weekend(df, "quali_score", event)
    return seen.withColumns({c: F.col(c).cast(types[c]) for c in ("grid", "quali_position")})


def _fitted(losses: DataFrame, out: str) -> DataFrame:
    by = ["series", "method"]
    enough = losses.groupBy(*by).agg(F.count_distinct("race_seq").alias("_n")).where(F.col("_n") >= MIN_CALIBRATION_EVENTS)
    fits = lw.fit_temperature(losses, by).join(enough, by)
    return fits.select("series", F.col("method").alias("stage"), F.col("temperature").alias(out))


def trailing_temperatures(history: DataFrame, s: Settings, race_sums: list[Row], quali_sums: list[Row]) -> tuple[DataFrame, DataFrame]:
    """(series, stage, temperature) of the race and of qualifying, from each series' last events as models of strictly earlier
    dates score them at that stage. A series with too few of them has no row."""
    age = F.dense_rank().over(W.partitionBy("series").orderBy(F.desc("race_seq")))
    recent = cut(history.select("series", "race_seq").distinct().withColumn("_a", age).where(F.col("_a") <= lw.TRAILING_EVENTS).drop("_a"))
    seen = history.join(recent, ev.EVENT, "left_semi")
    places = {"place": F.col("position").cast("double"), "quali_place": F.col("quali_position").cast("double")}
    seen = versions(seen.withColumns(places), "method")
    quali = ev.oos_scores(history, recent, QUALI_FEATURES, "quali_relevance", s.recency, None, RIDGE, varied=seen, sums=quali_sums).drop("cutoff")
    quali = cut(lw.sprint_blend(quali, "score", "sq_position", s.sprint, "quali_score", ev.METHOD_EVENT).drop("score"))
    late = F.col("method") == "post_quali"
    field = quali.where(late).unionByName(projected(quali.where(~late), ev.METHOD_EVENT))
    race = ev.oos_scores(history, recent, RACE_FEATURES, "race_relevance", s.recency, None, RIDGE, varied=field, sums=race_sums)
    race_t = _fitted(lw.temperature_losses(cut(race), "score", "place", event=ev.METHOD_EVENT), "_race_t")
    quali_t = _fitted(lw.temperature_losses(quali, "quali_score", "quali_place", event=ev.METHOD_EVENT), "_quali_t")
    return race_t, quali_t


def gridded(field: DataFrame) -> DataFrame:
    """The grid that the race model reads: the projected one before qualifying. Penalties move it unless it is official,
    which has them already; a grid that none touches is left as it is."""
    late = F.col("stage") == "post_quali"
    d = field.where(late).unionByName(projected(field.where(~late), AT))
    d = d.withColumn("drop", F.when(F.col("start_source").isin("projected", "qualifying"), F.col("drop")).otherwise(0.0))
    touched = F.max("drop").over(W.partitionBy(*AT)) > 0
    whole = ladders.starting_grid(d.withColumns({"_landed": F.col("grid"), "_touched": touched}), AT)
    whole = whole.withColumn("grid", F.when(F.col("_touched"), F.col("grid")).otherwise(F.col("_landed"))).drop("_landed", "_touched")
    return pen.apply_penalties(whole, AT)


def strength(finish: rk.Ranker, race: DataFrame, history: DataFrame) -> DataFrame:
    """(series, entity, season_strength): what an entrant is worth on a weekend that is not this one."""
    first = F.col("version") == F.min("version").over(W.partitionBy("series"))
    one = race.withColumn("_one", first).where("_one").drop("_one")
    ordinary = pj.typical_weekend(one.drop("version"), history, "median8")
    fallback = finish.score(ordinary, "typical").select("series", "entity", "typical")
    size = F.count(F.lit(1)).over(W.partitionBy(*ev.EVENT))
    past = finish.score(history.withColumn("_n", size).where(F.col("_n") >= LEAST_FIELD), "score")
    out = pj.season_strength(past.select(*ev.EVENT, "entity", "score"), fallback, "typical")
    return out.select("series", "entity", F.col("strength").alias("season_strength"))


def forecast(history: DataFrame, race: DataFrame, penalties: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One coherent table per version of an event, with its stage, the qualifying board and the reason per entrant.

    ``history``: rows of earlier events with features, labels and dates; ``race``: rows of the events to forecast, one
    event a series, with ``version``; ``penalties``: (event, entity, places; null is the back). Both models are
    fitted on all of history. An incoherent distribution is an error, and so is a history too short to train on."""
    history, race = cut(history), cut(race)
    race_sums, quali_sums = ev.event_sums(history, RACE_FEATURES, "race_relevance"), ev.event_sums(history, QUALI_FEATURES, "quali_relevance")
    finish = ev.fitted(history, RACE_FEATURES, "race_relevance", s.recency, None, RIDGE, sums=race_sums)
    quali = ev.fitted(history, QUALI_FEATURES, "quali_relevance", s.recency, None, RIDGE, sums=quali_sums)
    race_t, quali_t = trailing_temperatures(history, s, race_sums, quali_sums)

    # Qualifying: front-runners who start from the back whatever they do may hold back.
    field = quali.score(race.join(stage_of(race), AT), "_model", AT)
    field = lw.sprint_blend(field, "_model", "sq_position", s.sprint, "quali_score", AT).drop("_model")
    field = field.join(race_t, ["series", "stage"], "left").join(quali_t, ["series", "stage"], "left").withColumns(
        {"temperature": F.coalesce("_race_t", F.lit(s.temperature)), "quali_temperature": F.coalesce("_quali_t", F.lit(s.quali_temperature))}
    ).drop("_race_t", "_quali_t")
    field = pen.places_for(field, penalties, KEY).withColumn("held", pen.held_back())
    field = cut(pen.held_back_scores(field, "quali_score", "held", "held_score", AT))
    board = lw.ranking_forecast(field, "quali_score", F.col("quali_temperature"), "held_score", AT)
    board = board.select(*AT, "entity", *[F.col(c).alias(f"q_{c}") for c in ("p_win", "p_podium", "p_top5", "p_top10", "exp_position")])

    # The race.
    start = cut(gridded(field))
    scored = cut(finish.score(start, event=AT).withColumn("dnf_prob", lw.dnf_probability()))
    matrix = cut(lw.forecast(scored, "score", F.col("temperature"), s.blend, event=AT))
    problems = lw.check_distribution(matrix, AT)
    gate = problems.select(
        *AT,
        F.when(F.size("problems") > 0, F.raise_error(F.concat(F.lit("incoherent forecast: "), F.array_join("problems", ", "))).cast("boolean"))
        .otherwise(True).alias("_ok"),
    )
    keys = [*AT, "entity"]
    long = finish.contributions(start, AT, keep=()).join(start.select(*keys, "grid", "quali_position"), keys)
    apart = F.coalesce(F.abs(F.col("grid") - F.col("quali_position")) >= PENALTY_GAP, F.lit(False))
    why = rk.explain(rk.grouped_contributions(long, EXPLANATION_GROUPS, keys, apart), GROUP_LABELS, keys)
    table = lw.summarise(matrix, AT).join(gate, AT).where("_ok").drop("_ok")
    facts = scored.select(*keys, "season", "round", "stage", "start_source", "grid", "held", "temperature", "quali_temperature")
    out = table.join(facts, keys).join(board, keys).join(why, keys)
    return out.join(strength(finish, race, history), ["series", "entity"], "left")


def _dated(df: DataFrame, t: Tables) -> DataFrame:
    return df.join(t.calendar.select(*EVENT, ev.DATE), EVENT)


def run(t: Tables, now: Column, penalties: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The forecast of each series' next event, as it has landed by ``now``."""
    features = cut(ft.build(t, today=now.cast("date")))
    events = features.groupBy(*EVENT).agg(F.bool_or(F.col("position").isNotNull()).alias("ran"))
    nxt = ladders.next_event(events.join(t.calendar.select(*EVENT, "race_start"), EVENT), now, ["series"])
    race = features.join(nxt, EVENT, "left_semi").withColumn("version", F.lit("landed"))
    return forecast(_dated(features.where("position is not null"), t), race, penalties, s)


def replay(t: Tables, penalties: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The last date's events forecast again at every stage (``version``), from strictly earlier dates."""
    features = cut(_dated(ft.build(t, upcoming=False), t))
    last = features.agg(F.max(ev.DATE)).first()[0]  # one value
    race = versions(features.where(F.col(ev.DATE) == F.lit(last)), "version")
    return forecast(features.where(F.col(ev.DATE) < F.lit(last)), race, penalties, s)
