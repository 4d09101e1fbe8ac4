from pyspark.sql import functions as F

from pathlore.operators import environment

NODE = "struct<action:struct<type:string,text:string,raw:string>>"
SCHEMA = f"run long, at long, description string, nodes array<{NODE}>, states array<string>"


def node(kind, raw, text=None):
    return ((kind, text, raw),)


RUNS = [
    (1, 10, "Use the Calculator", [node("bash", "bash: open -a Safari"), node("bash", 'OPEN -a "Font Book" ; ls'), node("key", None, "Command+Space"), node("type", 'type: "Notes\nhello"'), (None,)], ["Safari shows a page"]),
    (2, 20, None, [node("key", 'key: "cmd+space"'), node("type_text", None, "My App!"), node("bash", "open 'x-apple.systempreferences:com.apple.SoundSettings'"), node("bash", "open 'x-apple.systempreferences:com.apple.Sound'")], None),
    (3, 30, "safari", [node("bash", "open -a safari"), node("bash", "open -a safari"), node("key_combo", "cmd+w"), node("key_combo", "cmd+w"), node("type", "Music"), node("key", "cmd+space"), node("type", "/tmp/file")], []),
    (4, 40, None, [], None),
    (5, 50, None, None, None),
]


def plain(state):
    return sorted((r.key, r.display, r.interactions, r.first_seen, r.last_seen, sorted((k, *v[2:]) for k, v in r.methods.items()), sorted((k, *v) for k, v in r.children.items())) for r in state.collect())


def test_facts(spark):
    df = spark.createDataFrame(RUNS, SCHEMA)
    got = {r[0]: r[1:] for r in plain(environment.entities(df))}
    assert set(got) == {"safari", "font-book", "notes", "my-app", "system-settings", "calculator"}
    # the two ways of writing it are two commands; a run counts once
    assert got["safari"] == ("Safari", 2, 10, 30, [('bash open -a "Safari"', 1, 10), ('bash open -a "safari"', 2, 30)], [])
    assert got["font-book"][0] == "Font Book" and got["notes"] == ("Notes", 1, 10, 10, [("spotlight", 1, 10)], [])
    assert got["my-app"][0] == "My App!" and got["calculator"][4] == []
    assert got["system-settings"][5] == [("sound", "Sound", "open 'x-apple.systempreferences:com.apple.Sound'", 1)]
    keys = {r.key: (r.action, r.observations, r.last_seen) for r in environment.shortcuts(df).collect()}
    assert keys == {"cmd+space": ("Open Spotlight (universal app/file launcher)", 3, 30), "cmd+w": ("Close current window/tab", 1, 30)}
    assert environment.entities(df.limit(0)).count() == 0 and environment.shortcuts(df.limit(0)).count() == 0


def test_increments_equal_one_pass(spark):
    df = spark.createDataFrame(RUNS * 1, SCHEMA)
    whole = plain(environment.entities(df))
    for cut in (0, 15, 25, 60):
        parts = [df.where(F.col("at") <= cut), df.where(F.col("at") > cut)]
        assert plain(environment.merged_entities(*map(environment.entities, parts))) == whole
        merged = environment.merged_shortcuts(*map(environment.shortcuts, parts))
        assert sorted(merged.collect()) == sorted(environment.shortcuts(df).collect())
    ways = environment.ways(environment.entities(df)).where("key = 'safari'").orderBy("command").collect()
    assert [(r.observations, r.confidence) for r in ways] == [(1, 0.25), (2, 0.4)]
    state = environment.entities(df)
    assert [r.key for r in environment.capped(state, 2, F.desc("interactions"), F.col("key")).collect()] == ["safari", "calculator"]
