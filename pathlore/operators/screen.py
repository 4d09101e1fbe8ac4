"""Elements of a screen: nearest to a point, found by name, role and place, and their shapes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions import patterns as p
from pathlore.functions.lessons import BOUNDARY
from pathlore.functions.text import edit_similarity


def distance(x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    return F.sqrt((to_x - x) * (to_x - x) + (to_y - y) * (to_y - y))


def within(points: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """Each point (x, y) beside the places (px, py) no farther than ``radius``, with their ``distance``.

    Places lie in square cells with sides of the radius, and points meet the nine cells around them:
    an equi-join, whose work follows the number of near pairs.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    own = points.withColumn("cell", around)
    held = places.withColumn("cell", F.struct(cell("px").alias("cx"), cell("py").alias("cy")))
    far = distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    return own.join(held, "cell").drop("cell").withColumn("distance", far).where(F.col("distance") <= radius)


def nearest(points: DataFrame, places: DataFrame, radius: float, point: str, place: str) -> DataFrame:
    """(point, place, distance): the nearest place of each point that has one within the radius, of equals the smallest.

    Points of one position are searched for once, and places of one position are met once. A screen has so many pixels only, so what
    meets is bounded by it, however many points and places there are.
    """
    held = places.groupBy("px", "py").agg(F.min(place).alias(place))
    best = within(points.select("x", "y").distinct(), held, radius).groupBy("x", "y").agg(F.min(F.struct("distance", place)).alias("b"))
    own = points.select(point, "x", "y").join(best, ["x", "y"]).groupBy(point).agg(F.min("b").alias("b"))
    return own.select(point, F.col(f"b.{place}").alias(place), "b.distance")


def count_within(points: DataFrame, places: DataFrame, radius: float, point: str, place: str) -> DataFrame:
    """(point, n, first): how many places each point has within the radius, if any, and the smallest; positions meet once, as in ``nearest``."""
    held = places.groupBy("px", "py").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    found = within(points.select("x", "y").distinct(), held, radius).groupBy("x", "y").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return points.select(point, "x", "y").join(found, ["x", "y"]).groupBy(point).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def confidence(far: Column, label: Column, actions: Column) -> Column:
    """How sure a click on an element is: by distance to its middle, by a label, and by what it offers."""
    near = F.when(far < 5, 0.4).when(far < 15, 0.3).when(far < 30, 0.15).when(far.isNotNull(), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + near + F.when(F.length(label) > 0, 0.1).otherwise(0.0) + F.when(F.array_contains(actions, "AXPress"), 0.05).otherwise(0.0))


def parsed(request: Column) -> Column:
    """Struct of a request's action, target, modifiers (places named with 'in') and the role that the action is for."""
    verb = F.lower(F.regexp_extract(request, f"(?i){BOUNDARY}({p.ACTION_WORDS}){BOUNDARY}", 1))
    action = F.when(verb == "", "click").otherwise(verb)
    target = F.trim(F.regexp_replace(request, f"(?i){BOUNDARY}({p.ACTION_WORDS}|the|a|an|on|in){BOUNDARY}", ""))
    target = F.trim(F.regexp_replace(target, f"(?i){BOUNDARY}in ({p.PLACE_WORDS}){BOUNDARY}", ""))
    places = F.transform(F.regexp_extract_all(request, F.lit(f"(?i){BOUNDARY}in ({p.PLACE_WORDS}){BOUNDARY}"), 1), lambda x: F.lower(x))
    role = F.try_element_at(F.create_map(*[F.lit(x) for kv in p.ROLE_OF_ACTION.items() for x in kv]), action)
    return F.struct(action.alias("action"), target.alias("target"), places.alias("modifiers"), role.alias("role"))


def role_fit(role: Column, action: Column) -> Column:
    """1 for a role that fits the action, else .3."""
    fits = F.lit(False)
    for verb, roles in p.FITTING_ROLES.items():
        fits = fits | ((action == verb) & role.isin(*roles))
    return F.when(fits, 1.0).otherwise(0.3)


def place_fit(path: Column, modifiers: Column) -> Column:
    """The share of the named places that the path has; 1 if none is named."""
    held = F.size(F.filter(modifiers, lambda m: F.contains(F.lower(path), m)))
    return F.when(F.size(modifiers) == 0, 1.0).otherwise(held / F.size(modifiers))


def offer_fit(actions: Column, action: Column) -> Column:
    """1 if the element offers what the action needs, or the action needs nothing; else 0."""
    needed = F.try_element_at(F.create_map(*[F.lit(x) for kv in p.OFFERED_ACTION.items() for x in kv]), action)
    return F.when(needed.isNull() | F.array_contains(actions, needed), 1.0).otherwise(0.0)


def relevance(request: Column, role: Column, label: Column, path: Column, actions: Column) -> Column:
    """How well an element fits a parsed request: label .4, role .3, place .2, offered action .1."""
    same = F.coalesce(edit_similarity(F.lower(label), F.lower(request.target)), F.lit(0.0))
    return 0.4 * same + 0.3 * role_fit(role, request.action) + 0.2 * place_fit(F.coalesce(path, F.lit("")), request.modifiers) + 0.1 * offer_fit(actions, request.action)


def search_tier(request: Column, role: Column, label: Column, path: Column) -> Column:
    """How an element answers a parsed request: 1 exact label, 2 near label, 3 role and part of the label, 4 place and part of it; null if not."""
    own, target = F.lower(label), F.lower(request.target)
    part = F.contains(own, target)
    places = (F.size(request.modifiers) > 0) & (place_fit(path, request.modifiers) == 1)
    return F.when(own == target, 1).when(edit_similarity(own, target) > 0.7, 2).when((role == request.role) & part, 3).when(places & part, 4)


def title_score(title: Column, query: Column) -> Column:
    """3 for the very title, 2 if it begins with the query, 1 if one contains the other; null if not."""
    t, q = F.lower(title), F.lower(query)
    return F.when(F.length(t) == 0, None).when(t == q, 3).when(t.startswith(q), 2).when(F.contains(t, q) | F.contains(q, t), 1)


def violations(kind: Column, role: Column, label: Column, path: Column, coordinates: Column) -> Column:
    """What is wrong with a semantic action; empty if nothing is."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(kind, F.lit("")) == "", "Missing action type"),
            F.when(F.coalesce(role, F.lit("")) == "", "Missing target.role"),
            F.when(label.isNull(), "Missing target.label"),
            F.when(F.coalesce(path, F.lit("")) == "", "Missing target.path"),
            F.when(coordinates.isNull() | (F.size(coordinates) != 2), "Missing or invalid fallback coordinates"),
        )
    )


def is_semantic(role: Column, label: Column) -> Column:
    return (F.coalesce(role, F.lit("")) != "") & label.isNotNull()


def description(role: Column, label: Column) -> Column:
    return F.when(is_semantic(role, label), F.concat(role, F.lit("["), F.when(label == "", "(unlabeled)").otherwise(label), F.lit("]"))).otherwise("coordinate-only action")


def path_of(role: Column, title: Column, parent: Column) -> Column:
    """``/AXApplication/AXWindow/parent/role[title]`` without the parts that are missing."""
    role = F.coalesce(role, F.lit("AXUnknown"))
    own = F.when(F.coalesce(title, F.lit("")) == "", role).otherwise(F.concat(role, F.lit("["), title, F.lit("]")))
    return F.concat(F.lit("/"), F.concat_ws("/", F.lit("AXApplication"), F.lit("AXWindow"), F.nullif(parent, F.lit("")), own))


def needs_picture(elements: Column, bare: Column, labels: Column, task: Column) -> Column:
    """Whether a screen's elements don't do: fewer than ten, some drawn freely (``bare``), or none named by the task's colour or kind of picture.

    A task that asks for a picture but names neither needs it only where no element has a label.
    """
    colour, kind, any_word = (F.lower(F.regexp_extract(task, f"(?i){BOUNDARY}({w}){BOUNDARY}", 1)) for w in (p.COLOUR_WORDS, p.PICTURE_WORDS, p.VISUAL_WORDS))
    word = F.when(colour != "", colour).otherwise(kind)
    named = F.exists(labels, lambda x: F.contains(F.lower(x), word))
    return (elements < 10) | bare | ((any_word != "") & ~named)


def state_hits(terms: Column, haystack: Column) -> Column:
    """How many of the terms a lower-case text contains."""
    return F.size(F.filter(terms, lambda t: F.contains(haystack, t)))


def step_verdict(far: Column, hits: Column, terms: Column) -> Column:
    """'incorrect' beyond 80 px, else as the state tells: 'correct' with two hits or half of the terms; 'partial' where nothing is known."""
    seen = (hits >= 2) | ((terms > 0) & (hits / F.greatest(terms, F.lit(1)) >= 0.5))
    return F.when(far > 80, "incorrect").when(hits.isNotNull(), F.when((terms > 0) & seen, "correct").otherwise("incorrect")).when(far <= 40, "correct").otherwise("partial")


def with_target(step: Column, semantic: Column) -> Column:
    """A step (a struct) with a semantic action's target, confidence and time laid over it; without one the three are null."""
    return step.withField("target", semantic.target).withField("semantic_confidence", semantic.confidence).withField("semantic_at", semantic.captured_at)
