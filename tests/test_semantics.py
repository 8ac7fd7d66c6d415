"""Rules that are easy to get wrong, on hand-made rows."""

import hashlib
import json
import os
import pathlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import codec, stats, text, vectors
from tessera.operators import balance, banding, clues, concordance, inference, integrity
from tessera.plans import schedule
from tessera.sources import boards, schemas, sinks
from tessera.streaming import replay, windows


def one(df):
    (r,) = df.collect()
    return r


def test_bands_ties_go_up(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "v double")  # cuts 1 and 2
    assert [r["band"] for r in banding.banded(rows, "v").orderBy("v").collect()] == [1, 2, 3, 3]


def test_congruence_cuts_neutral_first(spark):
    rows = spark.createDataFrame([(0.05, 1.0), (0.2, 1.0), (-0.2, 1.0), (0.2, 0.0)], "rho double, p double")
    assert [r[0] for r in rows.select(concordance.congruence(F.col("rho"), F.col("p"))).collect()] == ["neutral", "C+", "C-", "excluded"]
    assert [r[0] for r in spark.createDataFrame([(0.05,), (-0.06,)], "p double").select(concordance.admissible(F.col("p"))).collect()] == [False, True]


def cards(spark, rows):
    return spark.createDataFrame(rows, "turn int, model string, grp string, conf double, rho double, abs_p double, band int")


def test_pairs_stay_inside_turn_and_band(spark):
    rows = [(1, "m", "C+", 0.9, 0.3, 0.5, 1), (1, "m", "C-", 0.1, -0.1, 0.5, 2), (2, "m", "C+", 0.4, 0.2, 0.5, 1), (2, "m", "C-", 0.4, 0.0, 0.5, 1)]
    out = {r["band"]: r for r in concordance.pair_cells(cards(spark, rows), ["turn"], ["model"]).collect()}
    assert out[0]["n_pairs"] == 2 and out[1]["n_pairs"] == 1 and 2 not in out  # a mixed pair counts in the pool only
    assert out[0]["cit"] == pytest.approx(0.5 * (1 + 0.2 / 0.3), abs=1e-6)  # the tie weighs but has no sign
    assert out[1]["cit"] == 0.5


def test_absent_is_not_null(spark):
    assert concordance.pair_cells(cards(spark, [(1, "m", "C+", 0.9, 0.3, 0.5, 1)]), ["turn"], ["model"]).count() == 0
    y = spark.createDataFrame([("m", None, None)], "model string, stratum string, y int")
    got = {r["stratum"]: r for r in clues.iae(y, "model", "stratum").collect()}
    assert got["pooled"]["iae"] is None and got["pooled"]["n"] == 1 and got["<NULL>"]["none_rate"] == 1


def test_divergent_duplicates_drop_the_word(spark):
    rows = spark.createDataFrame([(1, "A", 0.5), (1, "a", 0.5), (1, "B", 0.5), (1, "b", 0.6), (1, "c", None)], "p int, w string, c double")
    got = {r["word_key"]: (r["confidence"], r["divergent"]) for r in concordance.resolve_rankings(rows, "p", "w", "c").collect()}
    assert got == {"a": (0.5, False), "b": (None, True)}


def test_history_is_strictly_earlier(spark):
    rows = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 3.0), ("g", 2, 9.0)], "g string, t int, rho double")
    got = sorted((r["rho"], r["polarity"]) for r in concordance.history_polarity(rows, "g", "t", "rho").collect())
    assert got == [(1.0, None), (3.0, None), (9.0, 2.0)]


def test_bootstrap_additive_equals_copies(spark):
    sums = spark.createDataFrame([(c, float(c), float(c + 2)) for c in range(5)], "cluster long, num double, den double")
    draws = inference.hash_draws(sums, "cluster", 7)
    got = {r["rep"]: r["value"] for r in inference.replicate_ratios(draws, sums, "cluster", "num", "den").collect()}
    by = {}
    for r in draws.collect():
        by.setdefault(r["rep"], []).extend([r["cluster"]] * r["mult"])
    assert all(len(v) == 5 for v in by.values())
    for rep, picked in by.items():
        assert got[rep] == pytest.approx(sum(picked) / sum(c + 2 for c in picked))
    n = inference.numpy_draws(spark, ["a", "b", "c"], 2026, 4)
    assert n.agg(F.sum("mult")).first()[0] == 12


def test_summary_needs_two_and_flags_dropped(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", None), ("a", None), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "cell string, value double")
    got = {r["cell"]: r for r in inference.summarise(v, 3, "cell").collect()}
    assert got["a"]["lo"] is None and got["a"]["n_dropped"] == 2 and not got["a"]["reliable"]
    assert got["b"]["reliable"] and got["b"]["se"] == 1.0
    t = spark.createDataFrame([(0.6, 0.8), (0.4, 0.6), (None, None)], "lo double, hi double")
    assert [r[0] for r in t.select(inference.excludes(F.col("lo"), F.col("hi"), 0.5)).collect()] == [True, False, None]


def test_effect_sizes_undefined(spark):
    rows = spark.createDataFrame([("k", True, 1.0), ("k", True, 1.0), ("k", False, 1.0), ("k", False, 1.0)], "k string, t boolean, x double")
    r = one(balance.effect_sizes(balance.two_group(rows, F.col("t"), "x", "k"), "k"))
    assert r["smd"] is None and r["cohen_d"] is None
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert one(flat.agg(balance.pearson("x", "y").alias("r")))["r"] is None


def test_cramers_v(spark):
    rows = spark.createDataFrame([("a", "x")] * 5 + [("b", "y")] * 5, "r string, g string")
    assert one(balance.cramers_v(rows, "r", "g"))["v"] == 1
    assert one(balance.cramers_v(rows.where("r = 'a'"), "r", "g"))["v"] is None


def test_caliper_match():
    assert balance.caliper_match([0.0, 0.1], [0.1, 0.1, 5.0], 1.0) == [(0, 0), (1, 1)]  # ties: lowest index
    assert balance.caliper_match([0.0], [5.0], 1.0) == []


def test_match_by_imputes_the_pool_floor(spark):
    rows = [("s", f"w{i}", i % 2 == 0, None if i == 0 else 2.5 + i / 10, 4 + i % 3, 1 + i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "specification string, text string, treated boolean, freq double, length int, polysemy int")
    got = balance.match_by(df, 10.0).collect()
    assert len(got) == 6 and len({r["major"] for r in got}) == 6


def test_tails():
    assert stats.t_sf(0.0, 5) == pytest.approx(0.5)
    assert stats.t_sf(2.015048, 5) == pytest.approx(0.05, abs=1e-6)
    assert stats.tost_p(0.0, 0.0, 1.0, 1.0, 50, 50) == pytest.approx(stats.t_sf(0.2 * math.sqrt(25), 98))
    assert stats.tost_p(1.0, 1.0, 0.0, 0.0, 5, 5) is None
    assert stats.mwu_p([1, 2, 3], [4, 5, 6]) == pytest.approx(0.1)
    assert stats.mwu_p([], [1]) is None and stats.mwu_p([1, 1], [1, 1]) is None


def test_seeds_and_identities(spark):
    h = hashlib.sha256(b"20260701:b1").digest()
    r = one(spark.createDataFrame([("20260701:b1",)], "x string").select(codec.seed_first8(F.col("x")).alias("a"), codec.uuid5(F.col("x")).alias("u")))
    assert int(r["a"]) == int.from_bytes(h[:8], "big")
    assert r["u"] == str(uuid.uuid5(uuid.UUID("6ba7b814-9dad-11d1-80b4-00c04fd430c8"), "20260701:b1"))
    for master in (0, 2026, 2**63, 2**64 - 1):
        cell = spark.createDataFrame([(7,)], "game_index int")
        g = one(schedule.with_identity(cell, master).withColumn("play", codec.turn_seed(F.col("derived_seed"), "seat", F.lit(1), F.lit(12))).withColumn("meas", codec.turn_seed(F.col("derived_seed"), "meas", F.lit(0), F.lit(12))))

        def derive(seed, *parts):
            return int.from_bytes(hashlib.sha256(seed.to_bytes(8, "big") + b"".join(parts)).digest(), "big") % 2**64

        game = derive(master, g["game_id"].encode())
        assert g["game_id"] == str(uuid.uuid5(uuid.UUID("6ba7b814-9dad-11d1-80b4-00c04fd430c8"), f"{master}:7"))
        assert [int(g[c]) for c in ("derived_seed", "engine_seed", "play", "meas")] == [game, derive(game, b"engine"), derive(game, b"seat1", (12).to_bytes(8, "big")), derive(game, b"meas0", (12).to_bytes(8, "big"))]
    v = [0.1, -2.5, 3e300]
    assert codec.decode_f64(codec.encode_f64(v)) == v
    assert one(spark.createDataFrame([(codec.encode_f64(v),)], "x string").select(codec.decode_f64_column("x").alias("v")))["v"] == v
    assert codec.content_id({"a": 1, "id": "x"}, ("id",)) == codec.content_id({"id": "y", "a": 1}, ("id",))
    frame = {"mu_bar": {"norm": 1, "dim": 2, "cos_with_axis": 3}, "created_at": "x", "name": "é", "norm": 5}
    assert codec.content_id(frame) == hashlib.sha256(b'{"mu_bar":{"dim":2},"name":"\\u00e9","norm":5}').hexdigest() and frame["mu_bar"]["norm"] == 1
    assert codec.fingerprint({"b": "2", "a": "1"}) == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()


def test_vectors(spark):
    r = one(spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(vectors.norm("a").alias("n"), vectors.cosine("a", "z").alias("c"), vectors.normalised("a").alias("u")))
    assert r["n"] == 5 and r["c"] == 0 and r["u"] == [0.6, 0.8]
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0],)], "z array<double>").select(vectors.normalised("z")).collect()
    with pytest.raises(Exception, match="not a unit vector"):
        spark.createDataFrame([([2.0, 0.0],)], "z array<double>").select(vectors.unit_checked("z", 2)).collect()


def test_text_rules(spark):
    r = one(spark.createDataFrame([("so ```json\n{}\n``` ```py x``` ", "gender-career", "ollama:a:b", "org/Llama3-8b", "sha256:AB")], "f string, s string, m string, l string, d string").select(
        text.strip_fence(F.col("f")).alias("f"), text.stratum_of(F.col("s"), "x").alias("s"), text.split_model_id(F.col("m"))[1].alias("m"), text.lineage_key(F.col("l")).alias("l"), text.normalise_digest(F.col("d")).alias("d"), text.stratum_of(F.lit(None).cast("string"), "neutral").alias("n")))
    assert tuple(r) == ("so \n{}\n ```py x```", "career", "a:b", "llama3", "ab", "neutral")
    empty = F.array().cast("array<string>")
    rows = [(" Sun ", []), ("fire", []), ("Fire", []), ("SunFire", []), ("sunzz", []), ("quaking", ["quake"]), ("ran", ["run"]), ("moon", ["moon"])]
    c = spark.createDataFrame(rows, "c string, l array<string>").select(text.clue_problem(F.col("c"), F.array(F.lit("sun"), F.lit("earthquake"), F.lit("running")), F.array(F.lit("fire")), F.col("l"), F.array(F.lit("sun"), F.lit("run")), F.array(F.lit("earth"), F.lit("fire"))))
    assert [x[0] for x in c.collect()] == ["on_board", "repeated", None, "compound", None, "component", "lemma", None]
    assert one(spark.range(1).select(text.clue_problem(F.lit("sunzz"), F.array(F.lit("sun")), empty, empty, empty)))[0] == "compound"
    d = spark.createDataFrame([("sha256:AB", "ab", "x/Gemma3-4b")], "p string, s string, m string")
    assert one(d.select(text.digest_gate(F.col("p"), F.col("s")), text.names_evaluated(F.col("m"), ["gemma3"])))[0:2] == ("ab", True)
    for bad in (("unknown", "ab"), ("ab", None), ("ab", "cd")):
        with pytest.raises(Exception, match="digest"):
            spark.createDataFrame([bad], "p string, s string").select(text.digest_gate(F.col("p"), F.col("s"))).collect()
    with pytest.raises(Exception, match="unknown result"):
        spark.createDataFrame([("loss_time",)], "r string").select(text.result_role(F.col("r"))).collect()


def test_board_rules(spark):
    pairs = schedule.key_card(7)
    assert len(pairs) == 25 and sum(a == "agent" for a, _ in pairs) == 9 and sum(b == "assassin" for _, b in pairs) == 3
    assert [p for p, n in schedule.JOINT_ROLES.items() for _ in range(n)][:4] == [("agent", "agent")] * 3 + [("agent", "bystander")]
    cs = [(f"w{i}", b, a) for i, (a, b) in enumerate(pairs)]
    schema = "board_id string, cards array<struct<text:string,llm_perspective_role:string,human_perspective_role:string>>"
    df = spark.createDataFrame([("good", cs), ("bad", [*cs[:24], ("W0", *cs[24][1:])])], schema)
    assert [tuple(r) for r in integrity.board_problems(df).collect()] == [("bad", "words")]
    dealt = schedule.key_cards(spark.createDataFrame([("b", 7)], "board_id string, seed long"))
    assert [(r["human_role"], r["llm_role"]) for r in dealt.orderBy("card_id").collect()] == pairs


#: A published board's seed, and its cards' roles (human face, model's face) by grid index.
BOARD_SEED = 13928928956058312419
BOARD_ROLES = (
    "bystander bystander, assassin bystander, bystander bystander, assassin agent, agent assassin, bystander agent, bystander assassin, bystander bystander, bystander bystander, bystander bystander, agent agent, agent bystander, agent bystander, "
    "bystander bystander, agent bystander, assassin assassin, agent agent, bystander agent, bystander bystander, agent agent, bystander agent, agent bystander, bystander agent, agent bystander, bystander agent"
)


def test_key_card_of_a_published_board():
    assert schedule.key_card(BOARD_SEED) == [tuple(r.split()) for r in BOARD_ROLES.split(", ")]


def test_identities_of_shipped_files(spark):
    """The content id of every frame, and the key card of every board, in the folder that SHIPPED_BOARDS names."""
    folder = os.environ.get("SHIPPED_BOARDS")
    if not folder:
        pytest.skip("SHIPPED_BOARDS names no folder")
    seen = 0
    for f in sorted(pathlib.Path(folder).glob("*.json")):
        doc = json.loads(f.read_text())
        if "frame_id" in doc:
            assert codec.content_id(doc) == doc["frame_id"]
        if "cards" in doc and doc.get("type"):
            name = {"civilian": "bystander"}
            cards = sorted(doc["cards"], key=lambda c: c["id"])
            assert schedule.key_card(doc["seed"]) == [tuple(name.get(c[k], c[k]) for k in ("human_perspective_role", "llm_perspective_role")) for c in cards], f.name
            seen += 1
    assert seen


def test_placement_and_composition(spark):
    words = [f"w{i}" for i in range(25)]
    b = spark.createDataFrame([("p", 11, words, words[:3]), ("c", 12, words, [])], "board_id string, seed long, words array<string>, dilemma array<string>")
    got = schedule.placements(b).collect()
    for i in ("p", "c"):
        mine = sorted((r["card_id"], r["text"], r["human_role"], r["llm_role"]) for r in got if r["board_id"] == i)
        assert sorted(r[1] for r in mine) == sorted(words) and [r[2:] for r in mine] == schedule.key_card(11 if i == "p" else 12)
        assert i == "c" or all(r[3] == "agent" for r in mine if r[1] in words[:3])
    treatment, control, pool = [f"m{i}" for i in range(9)], [f"f{i}" for i in range(9)], [f"n{i}" for i in range(60)]
    one_, two = (schedule.probe_words(("m0", "x", "n5"), treatment, control, pool, 3, i) for i in (0, 1))
    assert len(set(one_)) == 25 and one_[:3] == ["m0", "x", "n5"] and "f0" not in one_ and one_[3:15] != two[3:15]
    assert [w[1:] for w in one_[3:15:2]] == [w[1:] for w in one_[4:15:2]]
    assert not set(schedule.neutral_window(pool, 3, 0, 25)) & set(schedule.neutral_window(pool, 3, 1, 25))
    bank = [("a", "probe", True, ["male"]), ("b", "control", None, ["neutral"])]
    schema = "board_id string, type string, dilemma_ok boolean, categories array<string>"
    assert schedule.bank_problems(spark.createDataFrame(bank, schema), 1).count() == 0
    bad = [("a", "probe", False, ["male"]), ("a", "control", None, ["male"]), ("c", "probe", None, [])]
    assert sorted(r["problem"] for r in schedule.bank_problems(spark.createDataFrame(bad, schema), 1).collect()) == ["control with loaded words", "dilemma without consensus", "duplicate id", "not half probe and half control", "probe without a dilemma"]


def test_schedule_and_selection(spark):
    m = spark.createDataFrame([(f"m{i}",) for i in range(4)], "model string")
    b = spark.createDataFrame([(f"b{i:02}",) for i in range(16)], "board string")
    s = schedule.with_identity(schedule.build_schedule(m, b), 12345)
    assert s.count() == 192 and s.select("game_id").distinct().count() == 192 and s.agg(F.max("game_index")).first()[0] == 191
    rows = [(f"c{i}", "control", None) for i in range(9)] + [(f"p{i}", "probe", "gender-career") for i in range(5)] + [(f"s{i}", "probe", "gender-science") for i in range(4)] + [("u", None, None)]
    df = spark.createDataFrame(rows, "board_id string, type string, specification string")
    assert schedule.select_boards(df).count() == 16
    with pytest.raises(Exception, match="too few boards: science"):
        schedule.select_boards(df.where("board_id <> 's0'")).collect()


def test_ingest_delete_seal(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    new, counts = sinks.insert_if_absent(a, a.where("k = 1"), ["k"])
    assert [r["k"] for r in new.collect()] == [2] and tuple(one(counts)) == (1, 1)
    before, after = sinks.cascade_delete({"t": (a, "k")}, a.where("k = 2"), "k")["t"]
    assert before.count() == 3 and after.count() == 1
    f = spark.createDataFrame([("f", "enc")], "frame_id string, encoder string")
    assert sinks.ingest_frame(f, f, ["encoder"]).count() == 0
    with pytest.raises(Exception, match="stale frame"):
        sinks.ingest_frame(f, f.withColumn("encoder", F.lit("other")), ["encoder"]).collect()
    b = spark.createDataFrame([("b", None)], "board_id string, measurement_frame_id string")
    assert sinks.seal(sinks.seal(b, "f"), "f").first()[1] == "f"
    with pytest.raises(Exception, match="sealed with"):
        sinks.seal(sinks.seal(b, "f"), "g").collect()


def test_game_flush_links_by_place(spark):
    item = lambda w, c: {"word": w, "confidence": c}
    rv = lambda c, s, r: {"card_id": c, "acting_seat": s, "result_role": r}
    normal = {"turn_number": 0, "clue_giver_seat": 0, "phase": "normal", "clue": {"clue_word": "battle", "count": 2}, "reveals": [rv(0, 1, "agent"), rv(1, 1, "civilian")], "proposals": [{"kind": "play", "guesser_seat": 1, "items": [item("alpha", 0.9), item("BETA", 0.4), item("nowhere", 0.2)]}, {"kind": "measurement", "guesser_seat": 1, "items": [item("ALPHA", 0.8)]}]}
    sd = {"turn_number": 1, "clue_giver_seat": 0, "phase": "sudden_death", "clue": None, "reveals": [rv(3, 1, "agent")], "proposals": [{"kind": "play", "guesser_seat": 0, "items": [item("DELTA", 0.9)]}, {"kind": "play", "guesser_seat": 1, "items": [item("DELTA", 0.7)]}]}
    schema = "game_id string, board_id string, seats array<string>, turns array<struct<turn_number:int,clue_giver_seat:int,phase:string,clue:struct<clue_word:string,count:int>,reveals:array<struct<card_id:int,acting_seat:int,result_role:string>>,proposals:array<struct<kind:string,guesser_seat:int,items:array<struct<word:string,confidence:double>>>>>>"
    t = sinks.game_tables(spark.createDataFrame([("g", "b", ["m0", "m1"], [normal, sd])], schema))
    assert {k: t[k].count() for k in t} == {"game": 1, "game_seat": 2, "turn": 2, "clue": 1, "reveal_event": 3, "guess_proposal": 4, "guess_proposal_item": 6}
    words = spark.createDataFrame([("b", 0, "ALPHA"), ("b", 1, "BETA"), ("b", 3, "DELTA")], "board_id string, card_id int, text string")
    got = sorted((r["turn_number"], r["kind"], r["guesser_seat"], r["position"], r["resolved_card_id"], r["position_in_turn"]) for r in sinks.link_items(t["guess_proposal_item"], t["reveal_event"], words).collect())
    assert got == [(0, "measurement", 1, 0, 0, None), (0, "play", 1, 0, 0, 0), (0, "play", 1, 1, 1, 1), (0, "play", 1, 2, None, None), (1, "play", 0, 0, 3, None), (1, "play", 1, 0, 3, 0)]


def test_board_files(spark, tmp_path):
    good = '{"board_id": "b1", "type": "control", "seed": 18446744073709551615, "cards": [{"id": 0, "text": "ALPHA", "llm_perspective_role": "agent", "human_perspective_role": "civilian", "category": "neutral", "covariates": {"length": 5}}]}'
    for name, body in {"b1.json": good, "balance_report.json": good, "broken.json": "{", "noid.json": "{}"}.items():
        (tmp_path / name).write_text(body)
    b = boards.read_boards(spark, str(tmp_path))
    assert [r["board_id"] for r in b.collect()] == ["b1"] and int(b.first()["seed"]) == 2**64 - 1
    c = boards.word_cards(b)
    assert c.first()["weat_set"] == [] and c.first()["word_key"] == "alpha"
    assert {(r["seat"], r["role"]) for r in boards.roles_by_seat(c).collect()} == {(0, "agent"), (1, "civilian")}


def test_word_lists(spark, tmp_path):
    head = "word,gender_category,word_kind,source,weat_set,specification\n"
    (tmp_path / "w.csv").write_text(head + " Nurse ,female,attribute,b,weat-8,gender-career\nnurse,female,attribute,a,weat-7,gender-career\n,male,x,y,,\n")
    r = one(boards.read_words(spark, str(tmp_path)))
    assert r["source"] == "a; b" and r["weat_set"] == ["weat-7", "weat-8"]
    (tmp_path / "x.csv").write_text(head + "nurse,male,attribute,c,,gender-career\n")
    with pytest.raises(Exception, match="conflicting rows for nurse"):
        boards.read_words(spark, str(tmp_path)).collect()
    (tmp_path / "deck.txt").write_text("Apple\nice cream\napple\nRiver\n\nkayak\n")
    tokens = boards.playable_tokens(spark, str(tmp_path / "deck.txt"))
    assert [r["word"] for r in tokens.orderBy("ord").collect()] == ["apple", "river", "kayak"]
    got = boards.exclusion_reason(tokens, spark.createDataFrame([("apple",)], "word string"), spark.createDataFrame([("apple",), ("river",)], "word string"))
    assert {r["word"]: r["reason"] for r in got.collect()} == {"apple": "stoplist", "river": "already_loaded", "kayak": None}


def test_schemas_parse(spark):
    assert len(schemas.TABLES) == 18
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0


def test_readers_of_word_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("word,zipf,dom_pos\nSun,4.5,Noun\n sun ,3.5, Verb \n,1,x\nmoon,4,\n")
    assert {tuple(r) for r in boards.frequency_table(spark, str(tmp_path / "f.csv")).collect()} == {("sun", 3.5, "Verb"), ("moon", 4.0, "")}
    (tmp_path / "g.csv").write_text("word,zipf,dom_pos\nsun,many,Noun\n")
    with pytest.raises(Exception):
        boards.frequency_table(spark, str(tmp_path / "g.csv")).collect()
    raw = spark.createDataFrame([("Sun", "4.5", "Noun"), ("sun", "5.5", "Verb"), ("moon", "x", "Noun")], "`Word` string, `Zipf-value` string, `Dom_PoS_SUBTLEX` string")
    assert [tuple(r) for r in boards.frequency_rows(raw).collect()] == [("sun", 5.5, "Verb")]
    (tmp_path / "a.csv").write_text("word,pole\n He ,Male\n,male\nshe,female\nhe,male\n")
    a = boards.read_attributes(spark, str(tmp_path / "a.csv"))
    assert {tuple(r) for r in a.collect()} == {("he", "male"), ("she", "female")}
    loaded = spark.createDataFrame([("nurse", "female"), ("nurse", "female"), ("boss", "male"), ("x", "neutral")], "word string, category string")
    assert tuple(one(boards.pole_counts(a, loaded))) == (1, 1, 1, 1)
    for name, body, what in (("b.csv", "word,pole\nhe,up\n", "unknown pole up"), ("c.csv", "word,pole\nhe,male\nHe,female\n", "both poles: he")):
        (tmp_path / name).write_text(body)
        with pytest.raises(Exception, match=what):
            boards.read_attributes(spark, str(tmp_path / name)).collect()
    (tmp_path / "s.csv").write_text("word\nApple\n apple\n\n")
    words, digest = boards.read_stoplist(spark, str(tmp_path / "s.csv"))
    assert [r["word"] for r in words.collect()] == ["apple"] and digest == hashlib.sha256((tmp_path / "s.csv").read_bytes()).hexdigest()
    (tmp_path / "m.json").write_text('{"master_seed": 5, "dilemmas": ["a"]}')
    assert boards.read_manifest(str(tmp_path / "m.json")) == (5, ["a"])
    for body in ('{"master_seed": true, "dilemmas": []}', '{"master_seed": 1, "dilemmas": [2]}'):
        (tmp_path / "m.json").write_text(body)
        with pytest.raises(ValueError):
            boards.read_manifest(str(tmp_path / "m.json"))


def test_replay(spark):
    pairs = [("agent", "assassin"), ("civilian", "agent"), ("assassin", "civilian")]
    rows = [("g", i, s, c, *pairs[c], False, real) for i, (s, c, real) in enumerate([(0, 1, True), (1, 0, True), (0, 2, False)])]
    df = spark.createDataFrame(rows, "game_id string, ord int, seat int, card_id int, llm_role string, human_role string, ends_turn boolean, guessed boolean")
    assert tuple(one(replay.replay(df))) == ("g", "victory", 2, 9, False, 2)  # each guesser reads the other face
    g = replay.Game({0: ("agent", "agent"), 1: ("civilian", "agent"), 2: ("civilian", "civilian")}, tokens=0, sudden_death=True)
    assert g.guess(1, 0) == "agent" and g.guess(1, 2) is None and g.guess(0, 1) == "agent" and g.over == "victory_sd"  # seat 1 has none left


def test_stream_equals_batch(spark, small, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    out, n = str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "in")).count()
    windows.hourly_to_table(spark, str(tmp_path / "in"), out, str(tmp_path / "cp"))
    got = {(r["event_type"], r["hour"]): r["n"] for r in spark.read.parquet(out).collect()}
    batch = {(r["event_type"], r["hour"]): r["n"] for r in windows.hourly(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got.items() <= batch.items() and sum(got.values()) > 0.9 * n  # the last hours are still open


def test_overlap_counts_every_pair(spark):
    import itertools

    from tessera.plans import inference_queries

    sets = {1: {1, 501}, 60: {1, 501, 2}, 61: {502}, 100: {502, 3}}
    got = one(inference_queries.overlap(spark.createDataFrame([(s, p) for s, ps in sets.items() for p in ps] * 2, "s long, p long")))
    js = [(len(a & b), len(a & b) / len(a | b)) for a, b in itertools.combinations(sets.values(), 2)]
    assert got["n_pairs"] == 6 and got["max_shared"] == 2 and got["max_jaccard"] == pytest.approx(max(j for _, j in js), abs=1e-6)
    assert got["mean_jaccard"] == pytest.approx(sum(j for _, j in js) / 6, abs=1e-6)
    assert one(inference_queries.overlap(spark.createDataFrame([(1, 1)], "s long, p long")))["mean_jaccard"] is None


def test_history_takes_every_vector_of_the_next_label(spark, tmp_path):
    from tessera.plans import catalogue

    rows = [(1, 0, [1.0, 0.0]), (3, 1, [0.5, 1.0]), (7, 1, [2.0, 0.0]), (10, 1, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    (r,) = catalogue.queries()["q_history_similarity"](spark, str(tmp_path)).collect()
    assert (r["vec_id"], r["sim_max"], r["sim_mean"]) == (1, 2.0, pytest.approx(3.5 / 3, abs=1e-6))


def test_full_replicates_are_the_references(spark, small):
    from tessera.plans import catalogue

    (a, b) = catalogue.queries()["q_bootstrap_ci"](spark, small).collect()
    assert a["n_used"] + a["n_dropped"] == b["n_used"] + b["n_dropped"] == 2000
    p = one(catalogue.queries()["q_permutation_p"](spark, small))["p"]
    assert p * 10000 == pytest.approx(round(p * 10000)) and "generate_series(0, 9999)" in catalogue.oracle_sql()["q_permutation_p"]


def test_partition_labels_every_customer(spark, small):
    from tessera.plans import catalogue

    got = catalogue.queries()["q_admitted_partition"](spark, small)
    every = spark.read.parquet(f"{small}/customer.parquet")
    assert {r["c_custkey"] for r in got.collect()} == {r["c_custkey"] for r in every.collect()}
    assert got.where("grandfathered and not admitted").count() == 0 and got.where("not grandfathered").count() > 0


def test_interval_paths_agree(spark, monkeypatch):
    """Sums broadcast to the draws, or draws counted and joined by a shuffle; a point for every cell that has one."""
    rows = [("a", c, f"g{i}", i % (3 if c == "x" else 5), 5) for i in range(40) for c in ("x", "y")] + [("b", "x", f"g{i}", 1, 2) for i in range(7)]
    sums = spark.createDataFrame(rows, "model string, cell string, game_id string, num long, den long")
    universe = sums.select("model", "game_id").unionByName(spark.createDataFrame([("b", "alone")], "model string, game_id string"))
    run = lambda: sorted(map(tuple, inference.cluster_bootstrap(sums, universe, "game_id", ("model",), ["x", "y"], 50, (("gap", ("x",), ("y",)),), 0.5).collect()))
    want = run()
    assert [(r[0], r[1]) for r in want] == [("a", "gap"), ("a", "x"), ("a", "y"), ("b", "x")] and [r[2] for r in want][3] == 0.5
    monkeypatch.setattr(inference, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(inference, "_RUN", 3)
    assert run() == want


def test_cluster_numbers(spark):
    c = spark.createDataFrame([("m", f"c{i}") for i in range(300)] + [("k", "z")], "model string, c string")
    got = inference.numbered(c, "c", "model").collect()
    mine = sorted((r["ord"], r["c"]) for r in got if r["model"] == "m")
    order = sorted((f"c{i}" for i in range(300)), key=lambda x: (hashlib.md5(x.encode()).hexdigest()[:2], x))
    assert mine == list(enumerate(order)) and {r["n"] for r in got} == {300, 1}


def test_design_rules(spark):
    from tessera.operators import design

    f = spark.createDataFrame([("sun", 4.0)], "word string, zipf double")
    found, lost = design.frequency_lookup(spark.createDataFrame([("Sun",), ("moon",), ("Moon",)], "word string"), f)
    assert {(r["word"], r["zipf"]) for r in found.collect()} == {("Sun", 4.0), ("moon", None), ("Moon", None)} and [r["word"] for r in lost.collect()] == ["moon"]
    a, b = (spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "at int, value string") for vs in (("x", "y"), ("u", "v")))
    assert sorted(map(tuple, design.zipped(a, b, "at").collect())) == [(0, "x", "u"), (1, "y", "v")]
    with pytest.raises(Exception, match="unlike length"):
        design.zipped(a, b.limit(1), "at").collect()
    deck = spark.createDataFrame([("Apple",), ("pear",)], "word string")
    assert {tuple(r) for r in design.recall(deck, ["apple ", "fig"]).collect()} == {("apple", True), ("fig", False)}
    spec = spark.createDataFrame([("a/all-x", "1"), ("b/gte-y", "2")], "model_id string, revision string")
    assert design.arbiters_checked(spec, "a/all-x", ["llama"]).count() == 2
    for bad, primary, what in ((spec.where("false"), "a/all-x", "no arbiters"), (spec, "c", "primary"), (spec.withColumn("revision", F.lit(None).cast("string")), "a/all-x", "not pinned"), (spec, "a/all-x", None)):
        with pytest.raises(Exception, match=what or "evaluated model: b/gte-y"):
            design.arbiters_checked(bad, primary, ["gte"] if what is None else ["llama"]).collect()
    v = design.covariate_verdicts(spark.createDataFrame([(i % 2 == 0, float(i // 2), float(i)) for i in range(2000)], "t boolean, same double, apart double"), F.col("t"), ["same", "apart"])
    assert {r["covariate"]: (r["smd_ok"], r["equivalent"]) for r in v.collect()} == {"same": (True, True), "apart": (True, True)}
    far = design.covariate_verdicts(spark.createDataFrame([(i % 2 == 0, float(i % 2) * 9 + i % 5) for i in range(40)], "t boolean, x double"), F.col("t"), ["x"])
    assert tuple(one(far.select("smd_ok", "equivalent"))) == (False, False) and one(design.well_balanced(far))[0] is False


def test_frame_that_is_missing(spark):
    from tessera.flows import log as L

    empty = L.Log({n: schemas.empty(spark, n) for n in schemas.TABLES})
    with pytest.raises(L.MissingFrame):
        L.Geometry.load(empty, "none")


def test_artifacts(spark, tmp_path):
    from tessera.sources import artifacts

    doc = artifacts.frame_document({"name": "é"}, [0.0, 1.0], [3.0, 4.0], {"reference": 2}, "now", "1")
    assert doc["mu_bar"]["norm"] == 5 and doc["mu_bar"]["cos_with_axis"] == 0.8 and doc["frame_id"] == codec.content_id({k: v for k, v in doc.items() if k != "frame_id"})
    assert artifacts.frame_document({"name": "é"}, [0.0, 1.0], [3.0, 4.0], {"reference": 2}, "later", "1")["frame_id"] == doc["frame_id"]
    p = str(tmp_path / "d.json")
    record = {"specification": "s", "target": "t", "neutral_bridge": "n", "stereotypical_bridge": "b", "consensus_ok": True, "arbiter_scores": []}
    artifacts.write_dilemma(p, record)
    with pytest.raises(FileExistsError):
        artifacts.write_dilemma(p, record)
    assert artifacts.read_dilemma(p) == record and os.listdir(tmp_path) == ["d.json"]
    artifacts.write_json(p, {"target": 1})
    with pytest.raises(ValueError, match="no specification"):
        artifacts.read_dilemma(p)
    rows = spark.createDataFrame([("b", None, []), ("a", "s", ["x", "y"])], "word string, specification string, weat_set array<string>")
    assert artifacts.candidates_csv(rows) == "word,specification,weat_set\na,s,x;y\nb,,\n"
    audit = artifacts.provenance({"raw": 2}, spark.createDataFrame([("a", "stoplist"), ("b", None)], "word string, reason string"), {"f": p})
    assert audit["excluded"] == {"stoplist": ["a"]} and len(audit["inputs"]["f"]) == 64
    assert artifacts.report_lines(spark.createDataFrame([("m", 0.5), (None, None)], "model string, x double"), "model") == ["model  x", "-  -", "m  0.5000"]
    assert artifacts.rho_fixture_path("f", "8a404797aa") == os.path.join("f", "rho_reference_8a404797.json")


def test_runs_are_minted_and_boards_written_whole(spark):
    r = one(sinks.mint_run(spark, "r", 2**64 - 1, 0.5, {"b": 1, "a": 2}, {"t": "x"}))
    assert int(r["master_seed"]) == 2**64 - 1 and r["model_registry_snapshot"] == '{"a": 2, "b": 1}' and r["prompt_template_version"] == codec.fingerprint({"t": "x"})
    assert schemas.empty(spark, "run").unionByName(sinks.mint_run(spark, "r", 1, None, {}, {})).count() == 1
    cards = spark.createDataFrame([("b", 0, "sun", "agent", "bystander", "neutral", "deck", ["w"], 4.5, 3, 2)], "board_id string, card_id int, text string, llm_perspective_role string, human_perspective_role string, category string, source string, weat_set array<string>, subtlex_freq double, length int, wordnet_polysemy int")
    doc = json.loads(one(sinks.board_documents(cards, spark.createDataFrame([("b", "control")], "board_id string, type string")))["json"])
    assert doc["cards"] == [{"id": 0, "text": "SUN", "human_perspective_role": "civilian", "llm_perspective_role": "agent", "category": "neutral", "source": "deck", "weat_set": ["w"], "covariates": {"subtlex_freq": 4.5, "length": 3, "wordnet_polysemy": 2}}]
    run = spark.createDataFrame([("r",)], "run_id string")
    n, left = sinks.delete_run({"run": run, "game": spark.createDataFrame([("g", "r")], "game_id string, run_id string")}, "other")
    assert n == 0 and left["run"].count() == left["game"].count() == 1


def test_encoders_and_recipes(spark, tmp_path):
    from tessera.flows import encode
    from tessera.flows import log as L
    from tessera.sources import artifacts

    asked = []

    def lengths(texts):
        asked.extend(texts)
        return [[float(len(t)), 1.0] for t in texts]

    m = encode.memoised(lengths)
    assert m(["a", "bb", "a"]) == [[1.0, 1.0], [2.0, 1.0], [1.0, 1.0]] and m(["bb"]) == [[2.0, 1.0]] and asked == ["a", "bb"]
    assert encode.centred(lambda ts: [[2.0, 3.0] for _ in ts], [1.0, 1.0])(["x"]) == [[1.0, 2.0]]
    words = spark.createDataFrame([("Sun",), ("sun",), ("moon",), (None,), ("star",)], "word string")
    stored = spark.createDataFrame([("f", "Star"), ("g", "moon")], "frame_id string, text string")
    plain = lambda texts: [[float(len(t)), 1.0] for t in texts]
    got = encode.encode_missing(words, stored, "f", plain, 2, batch=1)
    assert {(r["text"], tuple(r["embedding"])) for r in got.collect()} == {("sun", (3.0, 1.0)), ("moon", (4.0, 1.0))}
    assert encode.encode_missing(words, stored.unionByName(got.select("frame_id", "text")), "f", plain, 2).count() == 0
    with pytest.raises(Exception, match="vectors of 3 components"):
        encode.encode_missing(words, stored, "f", plain, 3).collect()
    (tmp_path / "1").mkdir()
    (tmp_path / "modules.json").write_text(json.dumps([{"type": "st.models.Transformer", "path": ""}, {"type": "st.models.Pooling", "path": "1"}, {"type": "st.models.Normalize", "path": "2"}]))
    (tmp_path / "1" / "config.json").write_text(json.dumps({"word_embedding_dimension": 8, "pooling_mode_mean_tokens": True, "pooling_mode_cls_token": False}))
    recipe = artifacts.read_encoder_recipe(str(tmp_path))
    assert recipe == {"pooling": "mean", "dim": 8, "normalize": True}
    artifacts.check_encoder(recipe, "mean", 8, True)
    for bad in (("cls", 8, True), ("mean", 9, True), ("mean", 8, False)):
        with pytest.raises(ValueError):
            artifacts.check_encoder(recipe, *bad)
    (tmp_path / "1" / "config.json").write_text(json.dumps({"pooling_mode_mean_tokens": True, "pooling_mode_cls_token": True}))
    with pytest.raises(ValueError, match="2 pooling modes"):
        artifacts.read_encoder_recipe(str(tmp_path))
    with pytest.raises(L.MissingFrame):
        L.encoder_spec(L.Log({"measurement_frame": schemas.empty(spark, "measurement_frame")}), "f")


def test_boards_that_cannot_be_read_are_named(spark, tmp_path):
    for name, body in {"a.json": '{"board_id": "a", "cards": [{"id": 1, "text": "B"}, {"id": 0, "text": "A"}]}', "b.json": "{", "c.json": "{}", "d.json": '{"board_id": "d", "cards": []}', "balance_report.json": "{"}.items():
        (tmp_path / name).write_text(body)
    assert {tuple(r) for r in boards.unreadable_boards(spark, str(tmp_path)).collect()} == {("b.json", "not readable"), ("c.json", "no board id"), ("d.json", "no cards")}
    assert one(boards.card_texts(boards.read_boards(spark, str(tmp_path))))["texts"] == ["A", "B"]


def test_batches_pools_and_matching_reports(spark):
    from tessera.operators import batch

    g = spark.createDataFrame([("p", i, ok) for i, ok in enumerate([True, False, False, True, False, False, False, True, False])] + [("q", 0, False)], "unit string, k int, ok boolean")
    judged = batch.outcomes(g, "unit", "k", "ok", 3)
    assert [r["status"][0] for r in judged.where("unit = 'p'").orderBy("k").collect()] == list("ceeceeess")
    assert {tuple(r) for r in batch.report(judged, "unit").collect()} == {("p", 9, 7, 2, 5, 2, True), ("q", 1, 1, 0, 1, 0, False)}
    w = spark.createDataFrame([("Nurse", "female"), ("Aunt", "female"), ("Boss", "male"), ("Tree", "neutral"), ("nurse", "neutral")], "word string, category string")
    assert {r["word"] for r in batch.pool(w, "NURSE", True).collect()} == {"Aunt", "Tree"} and {r["word"] for r in batch.pool(w, "nurse", False).collect()} == {"Tree"}
    assert tuple(one(batch.thin(batch.pool(w, "nurse", False), 2))) == (1, True)
    assert [r["board"] for r in batch.missing(spark.createDataFrame([("a",), ("b",), ("b",)], "board string"), spark.createDataFrame([("a",)], "board string"), "board").collect()] == ["b"]
    waits = batch.backoff(spark.createDataFrame([(i,) for i in range(4)], "retry_index int")).orderBy("retry_index").collect()
    assert [r["waited"] for r in waits] == [0.0, 15.0, 30.0, 60.0] and [r["last"] for r in waits] == [False, False, False, True]
    rows = [("s", f"t{i}", True, float(i), 4, 2) for i in range(4)] + [("s", f"c{i}", False, float(i) if i < 5 else None, 4, 2) for i in range(7)]
    words = spark.createDataFrame(rows, "specification string, text string, treated boolean, freq double, length int, polysemy int")
    for caliper in (10.0, 0.0):
        r = one(balance.match_report(words, caliper))
        assert r["pairs"] == balance.match_by(words, caliper).count() and r["pairs"] + r["caliper_drops"] == 4 and r["excess"] == 3 and r["imputed"] == 2


def test_array_draws_equal_counted_draws(spark, monkeypatch):
    """Hashes worked out on arrays are MD5's; ratios of the array draws are those of the draw table, null cells included."""
    from tessera.operators import draws

    for rep in (0, 1999):
        assert draws.heads(rep, 1201).tolist() == [int(hashlib.md5(f"{rep}:{d}".encode()).hexdigest()[:8], 16) for d in range(1201)]
    rows = [(f"c{i}", k, i % 3, i % 5) for i in range(61) for k in ("x", None) if k or i < 2]
    sums = spark.createDataFrame(rows, "cluster string, k string, num long, den long")
    want = inference.replicate_ratios(inference.hash_draws(sums, "cluster", 40), sums, "cluster", "num", "den", "k")
    order = lambda df: sorted(map(tuple, df.select("rep", "k", "value").collect()), key=str)
    assert order(inference.bootstrap_ratios(sums, "cluster", "num", "den", 40, "k")) == order(want)
    monkeypatch.setattr(inference, "BROADCAST_ROWS", 0)
    assert order(inference.bootstrap_ratios(sums, "cluster", "num", "den", 40, "k")) == order(want)


def test_draws_never_become_rows(spark, small, monkeypatch):
    """A row for each of 2000 x clusters draws, counted and joined, failed at 60,000 clusters."""
    from tessera.plans import catalogue

    def no(*_, **__):
        raise AssertionError("draws became rows")

    monkeypatch.setattr(inference, "draw_slots", no)
    assert catalogue.queries()["q_bootstrap_ci"](spark, small).count() == 2


def test_dropped_ratios_never_become_rows(spark, small, monkeypatch):
    """q_bootstrap_dropped counted and joined its draws, which failed at 60,000 clusters."""
    from tessera.plans import catalogue

    def no(*_, **__):
        raise AssertionError("draws became rows")

    monkeypatch.setattr(inference, "draw_slots", no)
    assert catalogue.queries()["q_bootstrap_dropped"](spark, small).count() == 1


def _without_rows_of_draws(spark, small, monkeypatch, name):
    from tessera.plans import catalogue

    def no(*_, **__):
        raise AssertionError("draws became rows")

    monkeypatch.setattr(inference, "draw_slots", no)
    return catalogue.queries()[name](spark, small).collect()


def test_exclusions_never_make_rows_of_draws(spark, small, monkeypatch):
    assert {r["l_linestatus"] for r in _without_rows_of_draws(spark, small, monkeypatch, "q_excludes_null")} == {"F", "O"}


def test_contrast_never_makes_rows_of_draws(spark, small, monkeypatch):
    (r,) = _without_rows_of_draws(spark, small, monkeypatch, "q_paired_contrast")
    assert r["lo"] <= r["hi"]


def test_open_cards_are_not_exploded(spark, small):
    """A row for each turn, seat and card went through a shuffle; now no join stands above the cards."""
    from tessera.plans import catalogue

    plan = catalogue.queries()["q_open_cards"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "filter(" in above


def test_groups_share_hashes(spark, monkeypatch):
    """Every group hashed its draws anew, a row for each; now a hash is worked out once a replicate for all groups of a broadcast."""
    from tessera.operators import draws

    h = draws.heads(3, 50)
    cell = [(draws.np.arange(7), draws.np.ones(7), draws.np.full(7, 2.0))]
    assert draws.weighted(h, 7, cell) == [7.0, 7.0, 14.0]
    sums = spark.createDataFrame([(m, "x", f"g{i}", i, 1) for m in "ab" for i in range(9)], "model string, cell string, game_id string, num long, den long")
    monkeypatch.setattr(inference, "draw_slots", lambda *_: 1 / 0)
    a, b = inference.cluster_bootstrap(sums, sums.select("model", "game_id"), "game_id", ("model",), ["x"], 30).drop("model").collect()
    assert a == b


def test_sieve_keeps_every_row_of_its_keys(spark):
    from tessera.operators.staging import sieved

    rows, own = spark.range(20000).withColumn("k", F.concat(F.lit("g"), F.col("id").cast("string"))), spark.range(0, 20000, 50).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("k"))
    left = sieved(rows, "k", own)
    assert left.join(own, "k", "left_semi").count() == 400 and left.count() < 2000
    assert sieved(rows, "k", own.limit(0)).count() == 20000


def test_similarities_broadcast_or_joined_are_the_same(spark, monkeypatch):
    import numpy as np

    from tessera.flows import log as L

    rng = np.random.default_rng(5)
    vecs = spark.createDataFrame([(f"w{i}", [float(x) for x in rng.normal(size=7)]) for i in range(9)], "word string, v array<double>")
    axis = spark.createDataFrame([([1.0] + [0.0] * 6,)], "axis array<double>")
    rows = spark.createDataFrame([(f"w{i}", f"w{j}") for i in range(10) for j in range(10)] + [(None, "w1")], "a string, b string")
    found = lambda: sorted(map(str, L.Geometry(vecs, axis, 9).with_similarity(rows, "a", "b").select("a", "b", "similarity").collect()))
    got = [found()]
    monkeypatch.setattr(L, "MATRIX_WORDS", 0)
    got.append(found())
    assert got[0] == got[1] and len(got[0]) == 101


def test_similarities_round_half_up_of_the_decimal_text():
    import numpy as np

    from tessera.flows.log import _rounded_array

    assert _rounded_array(np.array([[0.15, 0.25, -0.25, 0.1249]]), 1).tolist() == [[0.2, 0.3, -0.3, 0.1]]


def test_history_of_a_seat_in_one_row(spark):
    from types import SimpleNamespace

    from tessera.flows import sudden_death
    from tessera.flows.log import Log

    log = Log({"turn": spark.createDataFrame([(1, "g1", 1, "normal"), (2, "g1", 1, "normal"), (3, "g1", 0, "sudden_death")], "turn_id long, game_id string, clue_giver_seat long, phase string"), "clue": spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "turn_id long, clue_word string")})
    geometry = SimpleNamespace(loads=spark.createDataFrame([("a", 0.5)], "word string, rho double"))
    (row,) = sudden_death.histories(log, spark.createDataFrame([("g1",)], "game_id string"), geometry).collect()
    assert (row["game_id"], row["giver"], row["p"], row["clue_words_without_embedding"], sorted(row["heard"])) == ("g1", 1, 0.5, 1, ["a", "b"])


def test_pairs_are_summed_before_they_fan_out(spark):
    from tessera.operators import concordance

    cards = spark.createDataFrame([(1, "m", "C+", 0.9, 0.5, 1.0, 1), (1, "m", "C+", 0.2, 0.4, 1.0, 2), (1, "m", "C-", 0.4, -0.5, 1.0, 1)], "t int, m string, grp string, conf double, rho double, abs_p double, band int")
    sums = concordance.pair_sums(cards, ["t"], ["m"])
    assert {r["band"]: (r["n_pairs"], round(r["num"], 9), round(r["den"], 9)) for r in sums.collect()} == {0: (2, 0.1, 1.9), 1: (1, 1.0, 1.0)}
    plan = sums._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate", plan.index("explode(array_compact")) == 2  # the sums of pairs, and the turns


def test_groups_sums_pass_the_driver_in_parts(spark, monkeypatch):
    from tessera.operators import inference

    sums = spark.createDataFrame([(g, "x", f"c{i}", (i * 7 + len(g)) % 5, 5) for g in ("a", "bb", "ccc") for i in range(12)], "g string, cell string, cluster string, num int, den int")
    run = lambda: sorted(map(str, inference.cluster_bootstrap(sums, sums.select("g", "cluster"), "cluster", ("g",), ["x"], 40).collect()))
    whole = run()
    monkeypatch.setattr(inference, "COLLECT_ROWS", 1)
    assert run() == whole and len(whole) == 3


def test_targets_of_turns_in_one_row(spark):
    from tessera.flows import log as L

    log = L.Log({"clue": spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "clue_id long, turn_id long"), "clue_target": spark.createDataFrame([(1, "A"), (1, "b"), (1, "a"), (3, "c")], "clue_id long, word string")})
    turns = spark.createDataFrame([(11, 1), (12, 2)], "turn_id long, clue_id long")
    got = {r["turn_id"]: sorted(r["targets"]) for r in L.targets_by_turn(log, turns).collect() if r["turn_id"] in (11, 12)}
    assert got == {11: ["a", "b"]}


def test_similarities_to_a_history_stay_in_the_card_row(spark, monkeypatch):
    """A card went through a shuffle once for each clue of its history; now its row meets them all at once. A word that a board has twice counts once."""
    from tessera.flows import log as L
    from tessera.flows import sudden_death

    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])], "word string, v array<double>")
    geometry = L.Geometry(words, spark.createDataFrame([([1.0, 0.0],)], "axis array<double>"))
    rows = [(1, "a", ["b", "c", "none"], False), (1, "a", ["b", "c", "none"], True), (2, "b", ["c"], False), (3, "none", ["a"], False), (4, "c", ["none"], False), (5, "c", [None, "c", "a", "a"], False)]
    ranked = spark.createDataFrame(rows, "proposal int, word string, heard array<string>, again boolean")
    ranked = ranked.selectExpr("*", "'m' as model", "'g' as game_id", "0 as seat", "'probe' as board_type", "'C+' as fate", "0.5D as confidence", "0.1D as rho", "0.2D as p", "false as divergent")
    staged = {}
    monkeypatch.setattr(sudden_death, "staged", lambda df, name: staged.setdefault(name, df))
    got = {True: None, False: None}
    for small in got:
        monkeypatch.setattr(L, "MATRIX_WORDS", 2048 if small else 0)
        geometry._known = None
        staged.clear()
        sudden_death.card_observations(ranked, geometry, 9)
        got[small] = sorted(tuple(r) for r in staged["cards"].select("proposal", "sim_max", "sim_mean").collect())
        if small:
            plan = staged["cards"]._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hash" not in plan and "Generate" not in plan
    assert got[True] == got[False] == [(1, 0.6, 0.3), (2, 0.8, 0.8), (3, None, None), (4, None, None), (5, 1.0, round(2.2 / 3, 9))]


def test_a_word_that_a_board_has_twice(spark):
    from tessera.flows import sudden_death

    cards = spark.createDataFrame([(1, 1, "a", "agent", "civilian"), (1, 2, "a", "civilian", "agent"), (1, 3, "a", "civilian", "civilian"), (1, 4, "b", None, None), (1, 5, "b", "civilian", None), (2, 1, "a", "civilian", "civilian")], "board_id int, card_id int, word string, llm_perspective_role string, human_perspective_role string")
    got = {(r["board_id"], r["card_id"]): (r["_earlier_llm"], r["_earlier_human"]) for r in sudden_death._with_earlier(cards).collect()}
    assert got == {(1, 1): (False, False), (1, 2): (False, True), (1, 3): (True, True), (1, 4): (False, False), (1, 5): (False, False), (2, 1): (False, False)}


def test_a_norm_is_worked_out_once_for_a_vector(spark):
    """It was worked out anew for each component that it divides."""
    v = spark.createDataFrame([([3.0, 4.0],), (None,)], "v array<double>")
    found = v.select(vectors.normalised("v").alias("u"), vectors.unit_checked(vectors.normalised("v"), 2).alias("w"))
    assert [tuple(r) for r in found.collect()] == [([0.6, 0.8], [0.6, 0.8]), (None, None)]
    assert "/ sqrt" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_cards_of_intervals_are_shuffled_once(spark):
    """A game without a pair has a row without a cell, so that the games need not be asked of the cards again."""
    from tessera.flows import guesser

    rows = [("m", "g1", 1, "probe", "C+", 0.9, 0.5, 1.0, 1), ("m", "g1", 1, "probe", "C-", 0.4, -0.5, 1.0, 1), ("m", "g1", 2, "probe", "C-", 0.4, -0.5, 1.0, 1), ("m", "g2", 3, "probe", "C+", 0.1, 0.5, 1.0, 2), ("m", "g2", 4, "probe", "C-", 0.1, -0.5, 1.0, 2)]
    cards = spark.createDataFrame(rows, "model string, game_id string, turn_id int, board_type string, grp string, conf double, rho double, abs_p double, band int")
    sums = guesser.interval_sums(cards, "turn_id", "load")
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, map(tuple, sums.collect()))) == ["('m', 'probe_all', 'g1', 1.0, 1.0)", "('m', 'probe_b1', 'g1', 1.0, 1.0)", "('m', None, 'g2', None, None)"]


def test_few_and_many_boards_rank_alike(spark, small, monkeypatch):
    """Rankings went through a shuffle for their targets and another for their board."""
    from tessera.flows import guesser
    from tessera.flows import log as L
    from tessera.plans import log_queries

    log, geometry = log_queries._log(spark, small)
    names, found, put = {}, {}, guesser.staged
    for few in (True, False):
        names[few] = []
        monkeypatch.setattr(L, "FEW_BOARDS", 10_000 if few else 0)
        monkeypatch.setattr(log, "_few", None)
        monkeypatch.setattr(guesser, "staged", lambda df, name, few=few: names[few].append(name) or put(df, name))
        _, words = guesser.ranked_words(log, guesser.guesser_turns(log, log_queries.MASTER), geometry)
        found[few] = sorted(map(str, words.select("proposal", "word", "confidence", "divergent", "fate", "rho", "p").collect()))
    assert found[True] == found[False] and len(found[True]) > 1000
    assert names == {True: ["guesser-turns"], False: ["guesser-turns", "aimed-rankings"]}


def test_independent_steps_run_together(spark):
    from threading import Barrier

    from tessera.operators.staging import _SWEEP, together

    met = Barrier(2, timeout=60)
    assert together(spark, lambda: met.wait() >= 0 and spark.range(3).count(), lambda: met.wait() >= 0 and spark.range(5).count()) == [3, 5]
    assert spark.conf.get(_SWEEP, None) is None
