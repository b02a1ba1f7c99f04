"""Every session takes one route, and nothing that was written is lost where a reply is missing."""

from datetime import date

from palimpsest.plans import preprocess

LONG = "word " * 40


def flow(spark, messages, acts=(), cleaned=(), segments=(), topics=(), scores=(), **options):
    m = spark.createDataFrame([(s, date(2024, 1, 2), *r) for s, *r in messages], "session_id long, event_date date, turn long, role string, text string, voice boolean")
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = preprocess.preprocess(
        m,
        frame(acts, "session_id long, turn long, operational boolean"),
        frame(cleaned, "session_id long, text string"),
        frame(segments, "session_id long, segment int, turn long, themes array<string>, era string"),
        frame(topics, "session_id long, idx long, text string, themes array<string>, era string"),
        frame(scores, "session_id long, episode_index int, coherence double, prompts array<string>"),
        **options,
    )
    return [df.collect() for df in out]


def test_every_session_takes_one_route(spark):
    messages = [
        (1, 0, "user", None, False), (1, 1, "user", "  ", False),
        (2, 0, "user", "too short", False),
        (3, 0, "user", LONG, False), (3, 1, "assistant", LONG, False), (3, 2, "user", "what time is it", False),
        (4, 0, "user", "find me this", False), (4, 1, "assistant", LONG, False),
        (5, 0, "user", LONG + "um, one", True),
        (6, 0, "user", LONG, False), (6, 1, "user", "and more", False),
        (7, 0, "system", LONG, False),
        (8, 0, "user", LONG, False), (8, 1, "assistant", "yes", False),
    ]
    acts = [(3, 2, True), (4, 0, True), (3, 0, None)]
    segments = [(3, 0, 0, ["b", "a"], "then"), (3, 0, 0, None, None), (8, 0, 99, ["x"], None)]
    topics = [(6, i, f"topic {i}", ["t", f"t{i}"], None) for i in range(4)] + [(6, 9, " ", None, None), (3, 0, "not of a dialogue", None, None)]
    scores = [(6, 1, 0.1, ["Why?", "Why?", " "]), (6, 2, 0.9, ["Never asked"]), (2, 1, 0.9, ["More?"])]
    outcomes, episodes, prompts = flow(spark, messages, acts, [(6, ""), (5, None), (2, " Too short. ")], segments, topics, scores, cap=3)
    got = {r.session_id: r for r in outcomes}
    assert len(outcomes) == 8 == len(got)
    assert {k: r.route for k, r in got.items()} == {1: "DISCARD", 2: "SHORT", 3: "TURNS", 4: "DISCARD", 5: "WHOLE", 6: "TOPICS", 7: "DISCARD", 8: "WHOLE"}
    assert {k: r.decision for k, r in got.items()} == {1: "DISCARD", 2: "RAW_CAPTURE", 3: "REFLECTION", 4: "DISCARD", 5: "REFLECTION", 6: "REFLECTION", 7: "DISCARD", 8: "REFLECTION"}
    assert {k for k, r in got.items() if r.uncleaned} == {1, 5, 6, 7} and {k for k, r in got.items() if r.unsplit} == {5, 8}
    by = {(r.session_id, r.episode_index): r for r in episodes}
    assert len(by) == sum(r.episodes for r in outcomes) == 8
    assert by[2, 1].text == "Too short." and by[2, 1].coherence == 0.0 and by[2, 1].entry_class == "RAW_CAPTURE"
    assert [by[3, i].text for i in (1, 2)] == ["Me: " + LONG, "AI: " + LONG] and by[3, 1].themes == ["a", "b"] and by[3, 1].era == "then"
    assert " um" not in by[5, 1].text
    assert [by[6, i].text for i in (1, 2, 3)] == ["topic 0", "topic 1", "topic 2\n\ntopic 3"] and by[6, 3].themes == ["t", "t2", "t3"]
    assert [by[6, i].entry_class for i in (1, 2, 3)] == ["RAW_CAPTURE", "REFLECTION", "REFLECTION"]
    assert by[6, 3].episode_id == "ep_2024_01_02_003" and by[6, 1].total_episodes == 3
    assert sorted((r.session_id, r.pos, r.prompt) for r in prompts) == [(2, 1, "More?"), (6, 1, "Why?")]


def test_no_sessions(spark):
    assert flow(spark, []) == [[], [], []]
