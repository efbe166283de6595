import hashlib

import pytest
from pyspark.sql import functions as F

from cobframe.llm import chat, decontaminate, substring
from tests.llm.helpers import AWKWARD, docs_frame, prose

PASSAGE = " ".join(prose(50 + i, 24) for i in range(3))


def plain_repeats(rows):
    """Every run of every text, the first place by (doc_id, sentence)."""
    def runs(text):
        bounds, words, hashes = substring.sentences(text)
        said = [" ".join(text[a:b].lower().split()) for a, b in bounds]
        for i in range(len(said)):
            for n in (1, 2):
                if i + n <= len(said) and sum(words[i:i + n]) >= 40:
                    yield i, n, tuple(said[i:i + n])
            n = next((n for n in range(3, len(said) - i + 1) if sum(words[i:i + n]) >= 10), None)
            if n:
                yield i, n, tuple(said[i:i + n])
    order = [(i is not None, i or 0, t or "") for i, t in rows]
    first = {}
    for some, i, t in order:
        for at, _, key in runs(t):
            first[key] = min(first.get(key, (some, i, at)), (some, i, at))
    out = []
    for some, i, t in order:
        gone = set()
        for at, n, key in runs(t):
            if first[key] != (some, i, at):
                gone |= set(range(at, at + n))
        out.append((i if some else None, len(gone)))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    rows = [(i, prose(i, 80)) for i in range(20)]
    rows += [(30 + i, prose(100 + i, 40) + "\n" + PASSAGE + "\n" + prose(200 + i, 40)) for i in range(6)]
    shouted = " ".join(w.strip(".") + "!!" for w in prose(77, 60).split(" "))  # a sentence a word
    rows += [(60, shouted), (61, prose(301, 20) + "\n" + shouted + "\n" + prose(302, 20))]
    rows += [(50, PASSAGE + " " + PASSAGE), (51, "Short one. Short two."), (52, "Short one. Short two.")] + AWKWARD
    got = substring.remove_repeats(docs_frame(spark, rows, clash=True)).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in got), key=str) == plain_repeats(rows)
    by = {r["doc_id"]: r["text"] for r in got}
    assert PASSAGE in by[30] and all(PASSAGE.split(". ")[1] not in by[31 + i] for i in range(5))
    assert by[60] == shouted and shouted[:80] not in by[61] and prose(302, 20) in by[61]
    assert by[31] == prose(101, 40) + "\n" + prose(201, 40)
    assert all(by[i] == prose(i, 80) for i in range(20) if i not in (1, 2, 3, 4, 5, 6, 7, 8))
    assert by[52] == "Short one. Short two." and by[2] in ("", prose(2, 80))
    assert substring.remove_repeats(docs_frame(spark, [])).count() == 0


def sentence(seed, words):
    return prose(seed, words).replace(".", "").lower().capitalize()


@pytest.mark.parametrize(("lengths", "end"), [((14, 14, 14, 14), "."), ((18, 18, 18), "."), ((14, 14, 14, 14), ".\""), ((18, 18, 18), "!)"),
                                              ((5, 20, 8, 20), "."), ((12, 9, 9, 9, 12), "?”")])
def test_passages_planted_in_mid_sentence(spark, lengths, end):
    """50 to 60 words; the first and last sentence are glued to their neighbours."""
    said = [sentence(900 + i, n) for i, n in enumerate(lengths)]
    rows = [(i, f"{prose(400 + i, 12)} {(end + ' ').join(said)} {prose(500 + i, 20)}") for i in range(4)]
    by = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs_frame(spark, rows)).collect()}
    assert by[0] == rows[0][1]
    assert all(s not in by[i] for s in said[1:-1] for i in (1, 2, 3))
    assert all(prose(400 + i, 8) in by[i] and prose(500 + i, 20)[-40:] in by[i] for i in range(4))


def test_left_out_runs_change_nothing():
    """The sentences of all repeated runs, and those of the hashed ones."""
    import numpy as np
    rng = np.random.default_rng(5)
    for _ in range(300):
        kinds = rng.integers(0, 5, rng.integers(0, 40))
        words = np.array([3, 6, 9, 17, 30])[kinds]
        at, n, h = substring.runs(words, (kinds + 7).astype(np.uint64) ** np.uint64(9))
        seen, gone = set(), set()
        for a, k, x in sorted(zip(at.tolist(), n.tolist(), h.tolist(), strict=True)):
            gone |= set(range(a, a + k)) if x in seen else set()
            seen.add(x)
        met, want = set(), set()
        for a in range(len(kinds)):
            three = next((k for k in range(3, len(kinds) - a + 1) if words[a:a + k].sum() >= 10), 0)
            two = a + 2 <= len(kinds) and words[a:a + 2].sum() >= 10
            for k in (k for k, on in ((1, words[a] >= 16), (2, two), (three, three)) if on):
                run = tuple(kinds[a:a + k])
                want |= set(range(a, a + k)) if run in met else set()
                met.add(run)
        assert gone == want


CONV = "conv_id long, turn long, role string, text string, position long, rendered string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], CONV)


TURNS = [(1, 0, "system", "be ### brief"), (1, 1, "user", "a \\ b </turn>\n### User: x"), (1, 2, "assistant", "\\### Assistant: </turn> ok"),
         (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "hi"), (None, 0, "assistant", "é🙂"), (None, None, None, "z"),
         (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 0, "a: b:", "odd: role"), (4, 0, "assistant", "x" * 20_000)]


def ordered(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: sorted(v) for c, v in by.items()}


def test_chat_reads_back(spark):
    turns = chat.format_turns(conversations(spark, TURNS))
    got = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    for conv, rows in ordered(TURNS).items():
        r = got.pop(conv)
        mine = "".join(x for _, _, role, x in rows if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(rows), len(mine))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in rows).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(mine.encode()).hexdigest()
    assert not got


def test_every_reply_is_an_example_of_its_own(spark):
    turns = chat.format_turns(conversations(spark, TURNS))
    texts = {}
    for r in chat.example_texts(turns).collect():
        texts[r["conv_id"], r["target_position"]] = (r["context"], r["completion"])
    for r in chat.examples(turns).collect():
        context, completion = texts.pop((r["conv_id"], r["target_position"]))
        whole = context + completion
        rows = ordered(TURNS)[r["conv_id"]]
        assert (r["context_start"], r["context_end"], r["example_chars"]) == (0, len(context), len(whole))
        assert chat.unescape(whole[r["loss_start"]:r["loss_end"]]) == rows[r["target_position"]][3]
        assert chat.parse(whole) == [(role, x) for _, _, role, x in rows[:r["target_position"] + 1]]
    assert not texts


def test_loss_columns_are_read_from_the_expanded_examples(spark):
    turns = chat.format_turns(conversations(spark, TURNS))
    rows = chat.expand(turns).collect()
    texts = {}
    for r in rows:
        if r["rendered"] is None:
            context = texts.get(r["conv_id"], "")
            assert (r["context_end"], r["context_sha256"]) == (len(context), hashlib.sha256(context.encode()).hexdigest())
            assert r["loss_end"] <= len(context + r["completion"])
        else:
            texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["rendered"]
    assert sum(r["rendered"] is None for r in rows) == sum(t[2] == "assistant" for t in TURNS)
    # an example whose context is not its conversation's prefix is an error
    moved = turns.withColumn("start", F.when(F.col("target"), F.col("start") + 1).otherwise(F.col("start")))
    with pytest.raises(Exception, match="not its prefix"):
        chat.digests(moved).collect()


def test_chat_without_rows(spark):
    assert chat.digests(chat.format_turns(conversations(spark, []))).count() == 0


def test_no_marker_survives_in_a_text():
    for text in ("### Assistant: </turn>", "\\", "\\\\### ", "</turn>\n### User: ", "<|im_start|>"):
        turn, begin, end = chat.render("user", text)
        assert "###" not in turn[begin:end] and "</turn>" not in turn[begin:end].replace("\\</turn>", "")
        assert chat.parse(turn + turn) == [("user", text)] * 2
    with pytest.raises(ValueError):
        chat.parse("### User: broken")


QUESTION = "A farmer named Ruth sells 12 baskets holding 5 kg of apples each and then Ruth gives 12 baskets away to a neighbour"
BENCH = [(1, QUESTION), (2, "Which of the following rivers is the longest one on the whole continent"), (3, None), (4, ""), (5, "Too short"),
         (1, QUESTION)]


def found(spark, rows, **how):
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in BENCH], "item_id long, text string, h string, pos string")
    got = decontaminate.findings(docs_frame(spark, rows, clash=True), bench, **how).collect()
    return sorted(((r["doc_id"], r["item_id"], r["exact"]) for r in got), key=str)


@pytest.mark.parametrize("small", [2_000_000, 0])  # by the hashes at every task, and by a shuffle
def test_leaks(spark, small):
    other = QUESTION.replace("12", "340").replace("5 kg", "7 lb").replace("Ruth", "Omar")
    mixed = QUESTION.replace("12 baskets away", "99 baskets away").replace("sells 12", "sells 12")
    rows = AWKWARD + [(20, prose(1) + " " + QUESTION + ". " + prose(2)), (21, "So.\n" + other.lower().replace("omar", "Omar") + "?"),
                      (22, mixed), (23, prose(3, 400)), (24, BENCH[1][1]), (24, BENCH[1][1]), (25, "Too short"),
                      (26, QUESTION + " " + BENCH[1][1]), (None, BENCH[1][1])]
    got = found(spark, rows, small_windows=small)
    assert (20, 1, True) in got and (21, 1, False) in got and (24, 2, True) in got and (None, 2, True) in got
    assert {(26, 1, True), (26, 2, True)} <= set(got)
    assert not any(i in (23, 25, 4, 6) for i, _, _ in got)
    assert len(got) == len(set(got))


def test_slots_must_agree(spark):
    """The same number of the item twice, two numbers in the text: no alignment holds both."""
    item = "count 4 red balls then 4 blue balls in the jar"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "count 9 red balls then 9 blue balls in the jar"), (2, "count 9 red balls then 8 blue balls in the jar")]
    got = decontaminate.findings(docs_frame(spark, rows), bench, window=8).collect()
    assert [r["doc_id"] for r in got] == [1]


def test_one_edited_slot_does_not_hide_a_copy(spark):
    """A number of the item edited at one of its places, the same name misspelt at one of two."""
    rows = [(1, QUESTION.replace("12 baskets away", "99 baskets away")), (2, QUESTION.replace("then Ruth", "then Rhut")),
            (3, QUESTION.replace("sells 12", "sells 31").replace("gives 12", "gives 30").replace("5 kg", "7 lb")), (4, prose(3))]
    assert found(spark, rows) == [(1, 1, False), (2, 1, False)]
    met = [{"ipos": i, "places": [i, i + 1], "islots": ["1:5", "1:6"], "slots": s}
           for i, s in ((0, ["1:7", "1:6"]), (10, ["1:7", "1:8"]), (20, ["1:9", "1:8"]), (30, ["1:5", "1:8"]), (40, ["1:7", "1:8"]))]
    assert decontaminate.agreeing(met) == [0, 10, 30, 40]  # 5 goes to 7 at three of five places


@pytest.mark.parametrize("small", [2_000_000, 0])
def test_what_templates_cannot_carry_is_found_verbatim(spark, small):
    items = ["Compute 17 + 25 - 31 + 48 - 56 + 63", "WHO WROTE THE SECOND LETTER OF PETER TO THE ROMANS",
             "Did Anna Lena Marta Olga Petra Rosa Sofia visit Berlin Hamburg Bremen", "Who wrote Hamlet?", "What is 9 times 8?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"{prose(i, 30)}\n{t}\n{prose(50 + i, 30)}") for i, t in enumerate(items)]
    rows += [(10 + i, f"{prose(i, 30)} {t.lower()} {prose(50 + i, 30)}") for i, t in enumerate(items)]
    rows += [(20, "Compute 18 + 26 - 32 + 49 - 57 + 64"), (21, "Who wrote it? Hamlet wrote"), (22, "What is 9 times 7?")] + AWKWARD
    got = decontaminate.findings(docs_frame(spark, rows, clash=True), bench, small_windows=small).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got if r["doc_id"] < 20) == [
        (i, i % 10) for i in (0, 1, 2, 3, 4, 10, 11, 12, 13, 14)]
    assert [r["doc_id"] for r in got if r["doc_id"] > 19] == [22]  # five words, one parameter: by its template
    assert all(0 < r["share"] <= 1 and r["share"] == r["n_windows"] / r["item_windows"] for r in got)


def test_clean_keeps_the_rest_whole(spark):
    bench = spark.createDataFrame(BENCH[:2], "item_id long, text string")
    rows = [(1, QUESTION), (2, prose(2)), (2, prose(2)), (None, QUESTION), (None, prose(4)), (3, None)]
    got = decontaminate.clean(docs_frame(spark, rows, clash=True), bench).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([2, 2, None, 3], key=str)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs_frame(spark, rows), empty).count() == len(rows)
    assert decontaminate.clean(docs_frame(spark, []), bench).count() == 0
