"""Nested episode assembly against a turn-by-turn fold over each episode."""

import random
from hashlib import md5

from curatio import constants as K
from curatio.plans import assembly as A

SHARING = "struct<rationale:string,image_description:string,image_source:string,keywords:string,image_id_from_mobile:string>"
SCHEMA = ("unique_id string, session_number long, name string, age long, gender string, birthplace string, residence string, persona_category string, "
          "persona_sent string, persona_key string, persona_value string, commonsense_relation string, narrative_sentence_form string, event_sequence string, "
          "history_event string, event string, date string, time_interval string, experience string, mobile_device array<string>, "
          f"dialogue array<struct<utterance_id:long,speaker:string,utterance:string,shape:string,sharing:array<{SHARING}>>>")


def _random_sessions(seed):
    r = random.Random(seed)
    rows = []
    for e in range(40):
        name = f"P{e}"
        for n in sorted(r.sample(range(1, 7), r.randint(1, 6))):
            turns = []
            for t in range(r.randint(0, 7)):
                shape = r.choice(["none", "dict", "dict", "list", "list", "other"])
                items = []
                for _ in range({"none": 0, "dict": 1, "list": r.randint(0, 4), "other": 0}[shape]):
                    items.append((r.choice(["", "why"]), r.choice(["", "", f"d{r.randint(0, 99)}"]), r.choice(["", "mobile", "mobile", "internet"]),
                                  r.choice(["", "kw"]), r.choice([None, "", "0", "1", " 2", "-1", "-9", "7", "x", "new image added", "new added image", "new added image"])))
                turns.append((t, r.choice([name, "", "user", "AI", "Somebody"]), r.choice(["", f"u{t}"]), shape, items))
            rows.append((f"e{e}", n, name, e, "g", "b", "r", f"cat{n}", "s", "k", "v", "rel", "form", "seq", f"h{n}", f"ev{n}", f"2024.01.0{n}", "1 day", "x",
                         [f"photo {i}" for i in range(e % 4)] if r.random() < 0.9 else None, turns))
    return rows


def _class(s):
    rat, desc, src, kw, ref = s
    if not any((rat, desc, src, kw, ref)):
        return 1
    if rat and not any((desc, src, kw, ref)):
        return 2
    if not desc and src == "mobile" and ref is not None and ref != "new added image":
        return 3
    if not desc and src == "internet" and kw:
        return 4
    return 6 if desc and src == "mobile" and ref == "new added image" else 7


def _fold(rows, names, texts):
    """Each episode turn by turn, the album a growing list."""
    out = {}
    for uid in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == uid), key=lambda r: r[1])
        album, sessions = list(own[0][19] or []), []
        owner = own[0][2]
        for i, r in enumerate(own):
            start, turns = list(album), []
            for place, (t, speaker, words, shape, items) in enumerate(r[20]):
                if shape == "other":
                    continue
                if speaker == "":
                    a = names.get((uid, f"{r[1]}|{place}"), "").lower()
                    speaker = owner if a in ("user", owner.lower()) else "AI Assistant" if a == "ai assistant" else None
                elif speaker != owner:
                    speaker = "AI Assistant" if speaker in K.ASSISTANT_SPEAKERS else owner
                done = []
                for k, s in enumerate(items):
                    c, desc = _class(s), s[1]
                    if c == 3:
                        try:
                            desc = album[int(s[4])]
                        except (ValueError, IndexError):
                            pass
                    if c == 4:
                        desc = texts.get((uid, f"{r[1]}|{place}|{k}"), desc)
                    if c == 6:
                        album.append(desc)
                    done.append((s[0], desc, s[2], s[3], s[4] if shape == "dict" else None))
                if shape == "dict" and _class(items[0]) in (1, 2):
                    shape, done = "none", []
                words = "<non verbal>" if words == "" and not done else words
                turns.append((t, speaker, words, shape, done))
            sessions.append((r[1], r[14:19], start, turns, list(album) if i == len(own) - 1 else None))
        out[uid] = (own[0][7], sessions)
    return out


def test_episodes_equal_the_fold(spark):
    rows = _random_sessions(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked, wanted = A.name_requests(df).collect(), A.description_requests(df).collect()
    names = {(r.unique_id, r.place): random.Random(i).choice(["User", "AI assistant", r.unique_id.replace("e", "p"), "who"]) for i, r in enumerate(asked)}
    texts = {(r.unique_id, r.place): f"an image {i}" for i, r in enumerate(wanted) if i % 5}
    empty = [(r[0], f"{r[1]}|{p}") for r in rows for p, t in enumerate(r[20]) if t[1] == ""]
    assert sorted((r.unique_id, r.place) for r in asked) == sorted(empty)
    schema = "unique_id string, place string, seq int, answer string"
    answers = spark.createDataFrame([(u, p, s, a if s == 1 else "late") for (u, p), a in names.items() for s in (1, 2)], schema)
    given = spark.createDataFrame([(u, p, 1, a) for (u, p), a in texts.items()], schema)
    got = A.postprocess(A.episodes(df, answers, given)).collect()
    want = _fold(rows, names, texts)
    assert len(got) == len(want) == len({r[0] for r in rows})
    for ep in got:
        category, sessions = want[ep.unique_id]
        assert ep.persona_category == category and ep.event_sequence == "seq"
        assert len(ep.episode) == len(sessions)
        for s, (number, slots, start, turns, last) in zip(ep.episode, sessions, strict=True):
            assert (s.session_number, (s.history_event, s.event, s.date, s.time_interval, s.experience)) == (number, slots)
            assert [(d.image_id, d.image_description) for d in s.mobile_device] == list(enumerate(start))
            assert [(u.utter_id, u.speaker, u.utter, u.shape, [tuple(x)[:5] for x in u.sharing]) for u in s.dialogue] == turns
            if last is None:
                assert s.last_added_mobile_device_image is None
            else:
                assert [d.image_description for d in s.last_added_mobile_device_image] == last


def test_requests_of_annotated_episodes(spark):
    from pyspark.sql import functions as F
    rows = _random_sessions(8)
    ep = A.annotate_images(A.episodes(spark.createDataFrame(rows, SCHEMA)).withColumn("face_image_path", F.lit("f.png"))
                           .withColumn("face_description", F.lit("face")))
    requests = A.route_requests(A.image_requests(ep)).collect()
    want = _fold(rows, {}, {})
    expected = set()
    for uid, (_c, sessions) in want.items():
        for i, d in enumerate(sessions[-1][4]):
            expected.add((uid, md5(f"{uid}|album|{i}".encode()).hexdigest(), d))
    album = {(r.unique_id, r.image_uuid, r.image_description) for r in requests} & expected
    assert album == expected and len({r.image_uuid for r in requests}) == len(requests)
    shared = sum(1 for _c, ss in want.values() for s in ss for u in s[3] for x in u[4] if u[3] == "list" or x[1])
    assert len(requests) == len(expected) + shared
    assert all(r.face_description == "face" and f"Name: {r.name}" in r.prompt and r.image_description in r.prompt for r in requests)
    by = {r.unique_id: r for r in ep.collect()}
    for r in by.values():            # every session names an image alike
        last = {d.image_id: d.image_uuid for d in r.episode[-1].last_added_mobile_device_image}
        assert all(last[d.image_id] == d.image_uuid for s in r.episode for d in s.mobile_device)


def test_name_prompt_holds_the_words_before(spark):
    image = [("", "cat", "mobile", "", None)]
    rows = [("e", 1, "Ann", *[0, *"gbrcskv"], "rel", "form", "seq", "h", "ev", "d", "i", "x", [],
             [(0, "Ann", "hello there", "none", []), (1, "Bob", "look", "dict", image), (2, "", "and", "none", []), (3, "Ann", "later", "none", [])]),
            ("e", 2, "Ann", *[0, *"gbrcskv"], "rel", "form", "seq", "h", "ev", "d", "i", "x", [], [(0, "Ann", "x", "none", [])]),
            ("e", 3, "Ann", *[0, *"gbrcskv"], "rel", "form", "seq", "h", "ev", "d", "i", "x", [], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    [got] = A.name_requests(df).collect()
    assert got.prompt.startswith("Dialogue:\nAnn: hello there\nBob: [Sharing Image]\n<SPEAKER>: [Sharing Image]\n\n")
    assert (got.utterance_id, got.place) == (2, "1|2")
    [one, two, none] = A.summary_requests(df).orderBy("session_number").collect()
    assert "Ann: hello there\nBob: [Sharing Image of cat]\n: and\nAnn: later" in one.prompt and none.session_number == 3 and two.session_number == 2
    plan = A.name_requests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
