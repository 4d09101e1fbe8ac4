"""Structured text taken apart and put together, as columns: markers, steps, names, times, layouts, scenes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p
from .lessons import BOUNDARY, matches


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the last match; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def markers(text: Column) -> Column:
    """Struct of what an agent's text declares: plan, checkpoints, step, expectation, scene, surprise. The last of each wins but for checkpoints."""
    block = F.regexp_extract(text, r"PLAN:\s*\n((?:\s*\d+\..+(?:\n|$))+)", 1)
    lines = F.filter(F.split(F.trim(block), "\n"), lambda x: x.rlike(r"^\s*\d+\.\s*.+"))
    plan = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)\.", 1).cast("long").alias("n"), F.trim(F.regexp_extract(x, r"^\s*\d+\.\s*(.+)", 1)).alias("desc")))
    cp = r"CHECKPOINT\s*\[(\d+)\]:\s*(.+)"
    numbers, texts = (F.regexp_extract_all(text, F.lit(cp), F.lit(i)) for i in (1, 2))
    checkpoints = F.zip_with(numbers, texts, lambda a, b: F.struct(a.cast("long").alias("step"), F.trim(b).alias("description")))
    surprise = r"SURPRISE:\s*([01](?:\.\d+)?)\s+(.*)"
    return F.struct(
        plan.alias("plan"),
        checkpoints.alias("checkpoints"),
        _last(text, r"STEP\s*\[(\d+)\]").cast("long").alias("step"),
        F.trim(_last(text, r"EXPECT:\s*(.+)")).alias("expectation"),
        F.trim(_last(text, r"SCENE:\s*(.+)")).alias("scene"),
        _last(text, surprise).cast("double").alias("surprise"),
        F.trim(_last(text, surprise, 2)).alias("surprise_reason"),
    )


def tutorial_steps(text: Column) -> Column:
    """Array of steps from numbered lines of fields between bars: index, action, target, expected state, why, pitfall; three fields at least."""
    block = F.regexp_extract(text, r"TUTORIAL:\s*\n([\s\S]*?)(?:\n\n[A-Z]+:|$)", 1)
    block = F.when(text.rlike(r"TUTORIAL:\s*\n"), block).otherwise(text)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*\d+[.)]\s+.+$"))

    def step(line: Column) -> Column:
        parts = F.transform(F.split(F.regexp_extract(line, r"^\s*\d+[.)]\s+(.+)$", 1), r"\|"), lambda x: F.trim(x))
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        index = F.regexp_extract(line, r"^\s*(\d+)", 1).cast("long") - 1
        own = F.struct(index.alias("index"), part(0).alias("action"), part(1).alias("target"), part(2).alias("expected"), part(3).alias("why"), part(4).alias("pitfall"))
        return F.when(F.size(parts) >= 3, own)

    return F.array_compact(F.transform(lines, step))


def video_id(text: Column) -> Column:
    """The 11 characters that name a video, by themselves or in an address; null if there are none."""
    found = F.regexp_extract(text, r"""(?i)(?:youtube\.com/(?:[^/]+/.+/|(?:v|e(?:mbed)?)/|.*[?&]v=)|youtu\.be/)([^"&?/\s]{11})""", 1)
    return F.when(text.rlike("^[a-zA-Z0-9_-]{11}$"), text).when(found != "", found)


def without_markdown(text: Column) -> Column:
    for pattern, new in ((r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^#+\s*", ""), (r"[*_~`]", "")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def model_tier(text: Column, asked: Column) -> Column:
    """'primary', 'default' or 'gatekeeper': what is asked for, else primary for hard requests."""
    hard = F.lit(False)
    for pattern in p.HARD_REQUESTS:
        hard = hard | F.coalesce(matches(text, pattern), F.lit(False))
    return F.when(asked.isin("primary", "default", "gatekeeper"), asked).when(hard, "primary").otherwise("default")


def code_errors(code: Column) -> Column:
    """What speaks against a made tool's code: its length, and what it must not have. (Syntax is not looked at.)"""
    found = [F.when(matches(code, pattern, False), f"Blocked pattern detected: {pattern}") for pattern in p.BLOCKED_CODE]
    return F.array_compact(F.array(F.when(F.length(code) > p.LONGEST_CODE, F.concat(F.lit("Code exceeds max length: "), F.length(code), F.lit(f" > {p.LONGEST_CODE}"))), *found))


def step_cost(kind: Column, text: Column, waits: Column, timeout: Column) -> Column:
    """Milliseconds of one step of a workflow over applications: the switch, the action and the wait (5 s unless told)."""
    action = F.when(kind.isin("click", "double_click"), 300).when(kind == "type", 500 + 50 * F.coalesce(F.length(text), F.lit(0))).when(kind == "key", 200).when(kind == "launch", 2000).when(kind.isNotNull(), 500).otherwise(0)
    return 500 + action + F.when(waits, F.when(F.coalesce(timeout, F.lit(0)) == 0, 5000).otherwise(timeout)).otherwise(0)


def workflow_errors(name: Column, steps: Column) -> Column:
    """What is wrong with a workflow: no name, no steps, or steps without application, action or a positive timeout."""

    def of(s: Column, i: Column) -> Column:
        at = lambda what: F.concat(F.lit("Step "), i, F.lit(f": {what}"))
        return F.array_compact(F.array(F.when(F.coalesce(s.app, F.lit("")) == "", at("missing or invalid app name")), F.when(s.action.isNull(), at("missing or invalid action")), F.when(s.timeout < 0, at("invalid timeout (must be positive number)"))))

    none = F.coalesce(F.size(steps), F.lit(0)) <= 0
    head = F.array_compact(F.array(F.when(F.coalesce(name, F.lit("")) == "", "Workflow must have a name"), F.when(none, "Workflow must have non-empty steps array")))
    return F.when(none, head).otherwise(F.concat(head, F.flatten(F.transform(steps, of))))


def next_run(kind: Column, at: Column, seconds: Column, now: Column) -> Column:
    """When a schedule runs next, in seconds: at its date, or after its interval (60 unless told); null for others."""
    return F.when(kind == "date", at).when(kind == "interval", now + F.when(F.coalesce(seconds, F.lit(0)) == 0, 60).otherwise(seconds))


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def layout(kind: Column, count: Column, width: Column, height: Column) -> Column:
    """Array of rectangles (x, y, width, height) of a screen's windows: split-left, split-right, quarters, thirds, stack; null for a kind or number that doesn't fit."""

    def rect(x, y, w, h) -> Column:
        return F.struct(*[_half_up(v).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "width"), (h, "height"))])

    zero, half_w, half_h = F.lit(0.0), width / 2, height / 2

    def split(first: Column, rest: Column) -> Column:
        more = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: rect(rest, height / (count - 1) * (i - 1), half_w, height / (count - 1)))
        return F.when(count > 1, F.concat(F.array(rect(first, zero, half_w, height)), more)).otherwise(F.array(rect(first, zero, half_w, height)))

    quarters = F.array(*[rect(x, y, half_w, half_h) for y in (zero, half_h) for x in (zero, half_w)])
    thirds = F.array(*[rect(width / 3 * i, zero, width / 3, height) for i in range(3)])
    stack = F.transform(F.sequence(F.lit(0), count - 1), lambda i: rect(zero, height / count * i, width, height / count))
    return F.when(kind == "split-left", split(zero, half_w)).when(kind == "split-right", split(half_w, zero)).when((kind == "quarters") & (count == 4), quarters).when((kind == "thirds") & (count == 3), thirds).when(kind == "stack", stack)


def grid(rows: int, cols: int, width: Column, height: Column) -> Column:
    """Array of the rectangles of a grid's cells, by rows."""
    cell = lambda i: F.struct(_half_up(width / cols * (i % cols)).alias("x"), _half_up(height / rows * F.floor(i / cols)).alias("y"), _half_up(width / cols).alias("width"), _half_up(height / rows).alias("height"))
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), cell)


def verb(action: Column) -> Column:
    return F.when(action == "left_click", "Clicked").when(action == "double_click", "Double-clicked").when(action == "right_click", "Right-clicked").otherwise("Interacted with")


def action_state(target: Column, intent: Column, action: Column, raw: Column, text: Column, coordinates: Column) -> Column:
    """What a step's state is called without a scene: its target (a struct of label, role, app), the intent, or the action itself."""
    app = F.when(F.coalesce(target.app, F.lit("")) != "", F.concat(F.lit(" in "), target.app)).otherwise(F.lit(""))
    of_target = F.concat(verb(action), F.lit(" '"), target.label, F.lit("' ("), target.role, F.lit(")"), app)
    typed = F.coalesce(text, F.lit(""))
    of_action = (
        F.when(action == "key", F.concat(F.lit("Pressed key: "), typed))
        .when(action == "type", F.concat(F.lit('Typed: "'), F.substring(typed, 1, 50), F.lit('"')))
        .when((action == "left_click") & coordinates.isNotNull(), F.concat(F.lit("Clicked at ("), coordinates[0], F.lit(", "), coordinates[1], F.lit(")")))
        .when(action == "screenshot", "Screenshot captured")
        .otherwise(F.coalesce(F.nullif(raw, F.lit("")), action))
    )
    return F.when(target.isNotNull(), of_target).when(F.coalesce(intent, F.lit("")) != "", intent).when(action.isNotNull(), of_action).otherwise("initial state (no action)")


def scene(state: Column, checkpoint: Column, otherwise: Column) -> Column:
    """A step's scene: its state unless that only echoes an action, else its checkpoint's description, else what else is known."""
    echo = state.startswith("left_click") | state.startswith("key ")
    said = (F.coalesce(state, F.lit("")) != "") & ~F.coalesce(echo, F.lit(False))
    return F.when(said, state).when(F.coalesce(checkpoint, F.lit("")) != "", F.concat(F.lit("[Checkpoint] "), checkpoint)).otherwise(otherwise)


def macro_name(apps: Column, actions: Column) -> Column:
    """``App, App: action > action > action``, of the first two distinct applications and three actions."""
    own = F.array_distinct(F.filter(apps, lambda a: F.coalesce(a, F.lit("")) != ""))
    head = F.when(F.size(own) > 0, F.array_join(F.slice(own, 1, 2), ", ")).otherwise("Desktop")
    told = F.array_compact(F.slice(actions, 1, 8))
    return F.when(F.coalesce(F.size(actions), F.lit(0)) <= 0, "Untitled Macro").otherwise(F.concat(head, F.when(F.size(told) > 0, F.concat(F.lit(": "), F.array_join(F.slice(told, 1, 3), " > "))).otherwise(F.lit(""))))


def short_name(apps: Column, actions: Column) -> Column:
    """``App+App: action > action``, of two applications and the first two actions of five steps; ``App Macro`` without actions."""
    own = F.array_distinct(F.array_compact(apps))
    head = F.when(F.size(own) > 0, F.array_join(F.slice(own, 1, 2), "+")).otherwise("Desktop")
    told = F.slice(F.array_compact(F.slice(actions, 1, 5)), 1, 2)
    return F.when(F.size(told) > 0, F.concat(head, F.lit(": "), F.array_join(told, " > "))).otherwise(F.concat(head, F.lit(" Macro")))


def action_name(kind: Column, title: Column, text: Column, keys: Column) -> Column:
    """What a recorded step is called in a macro's name; null if it isn't."""
    short = F.concat(F.substring(text, 1, 20), F.when(F.length(text) > 20, "...").otherwise(F.lit("")))
    return F.when((kind == "click") & (F.coalesce(title, F.lit("")) != ""), F.concat(F.lit("Click "), title)).when((kind == "text_input") & (F.coalesce(text, F.lit("")) != ""), F.concat(F.lit('Type "'), short, F.lit('"'))).when(kind == "key_combo", keys)


def resolved(text: Column, values: Column) -> Column:
    """The text with ``{{name}}`` replaced by the map's value of the name; names that it lacks stay. Values are not looked at again."""
    # parts before, between and behind the placeholders, and the placeholders' names
    between, names = F.split(text, r"\{\{[a-zA-Z0-9_]+\}\}"), F.regexp_extract_all(text, F.lit(r"\{\{([a-zA-Z0-9_]+)\}\}"), F.lit(1))
    put = F.transform(names, lambda n: F.coalesce(F.try_element_at(values, n), F.concat(F.lit("{{"), n, F.lit("}}"))))
    return F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def chapter(time: Column, timestamp: Column, title: Column, name: Column) -> Column:
    """A chapter's time and title under either of two keys."""
    full = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit(""))
    return F.struct(full(time, timestamp).alias("time"), full(title, name).alias("title"))


def has_word(text: Column, words: str) -> Column:
    return text.rlike(f"(?i){BOUNDARY}({words}){BOUNDARY}")
