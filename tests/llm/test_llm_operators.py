"""Each operator on literal rows: nulls, empty and very long texts, ties, repeated rows, empty tables, columns with clashing names."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.llm import conversations, encoding, leakage, neardup, packing, pairs, residue, splitting

MESSAGES = "message_id string, conversation_id string, role string, content string, created_at string, ingested_at string"


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGES).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "ingested_at")})


def at(minute):
    return f"2025-01-01 10:{minute:02d}:00"


# Problem 1


def test_conversations(spark):
    rows = [
        ("1", "ok", "User ", "hi?", at(1), at(1)), ("2", "ok", "bot", "yes 1", at(1), at(1)), ("2", "ok", "bot", "yes", at(1), at(0)), ("s", "ok", "SYSTEM", None, None, at(1)),
        ("3", "gone", "user", "a", at(1), at(1)), ("4", "gone", "model", "b", at(2), at(2)),
        ("5", "untimed", "user", "a", None, at(1)), ("6", "untimed", "assistant", "b", at(2), at(2)),
        ("7", "odd", "user", "a", at(1), at(1)), ("8", "odd", "tool", "b", at(2), at(2)),
        ("9", "blank", "user", "?!", at(1), at(1)), ("10", "blank", "assistant", "b", at(2), at(2)),
        ("11", "open", "user", "a", at(1), at(1)),
        ("12", "twice", "user", "a", at(1), at(1)), ("13", "twice", "user", "a", at(2), at(1)), ("14", "twice", "assistant", "a", at(3), at(1)), ("15", "twice", "assistant", "a", at(4), at(1)),
        (None, "ok2", "user", "a", at(1), at(1)), (None, "ok2", "assistant", "b", at(2), at(1)), ("16", None, "user", "a", at(1), at(1)),
    ]
    known = spark.createDataFrame([(c,) for c in ("ok", "ok", "untimed", "odd", "blank", "open", "twice", "none", "ok2", None)], "conversation_id string").withColumn("content", F.lit(1)).withColumn("id", F.lit(2))
    judged, talk = conversations.thread_conversations(messages(spark, rows).withColumn("id", F.lit(0)), known)
    got = {r.conversation_id: r.reason for r in judged.collect()}
    assert got == {
        "ok": None, "ok2": None, "gone": "unknown_conversation", "untimed": "unplaced_message", "odd": "unplaced_message", "blank": "blank_content", "open": "no_reply", "twice": "not_alternating", "none": "no_messages",
    }
    done = conversations.rebuild_conversations(messages(spark, rows), known).orderBy("conversation_id", "position").collect()
    assert [(r.conversation_id, r.position, r.role, r.content) for r in done] == [("ok", 1, "user", "hi?"), ("ok", 2, "assistant", "yes 1"), ("ok2", 1, "user", "a"), ("ok2", 2, "assistant", "b")]


def test_conversations_of_empty_tables(spark):
    none = messages(spark, [])
    judged, talk = conversations.thread_conversations(none, spark.createDataFrame([], "conversation_id string"))
    assert judged.count() == 0 and talk.count() == 0


def test_threads_with_branches_orphans_and_cycles(spark):
    edges = [("a", "R"), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "lost"), ("f", "e"), ("g", "h"), ("h", "g"), ("i", None)] + [(f"n{i}", f"n{i - 1}" if i else "R") for i in range(70)]
    nodes = spark.createDataFrame(edges, "id string, parent string")
    roots = spark.createDataFrame([("R",), ("unused",)], "id string")
    resolved, jumps = conversations.resolve_threads(nodes, roots)
    got = {r.id: (r.state, r.depth) for r in resolved.collect()}
    assert got["d"] == ("ok", 3) and got["f"] == ("orphan", None) and got["i"] == ("orphan", None) and got["g"] == got["h"] == ("cycle", None) and got["n69"] == ("ok", 70)
    paths = conversations.root_to_leaf_paths(nodes, resolved, jumps).collect()
    by = {}
    for r in paths:
        by.setdefault(r.leaf, []).append((r.position, r.id))
    assert [i for _, i in sorted(by["c"])] == ["a", "b", "c"] and [i for _, i in sorted(by["d"])] == ["a", "b", "d"] and [i for _, i in sorted(by["n69"])] == [f"n{i}" for i in range(70)]


def test_given_parents_with_branches_orphans_and_cycles(spark):
    rows = [
        ("a", "one", "user", "q", None), ("b", "one", "assistant", "x", "a"), ("c", "one", "assistant", "y", "a"), ("d", "one", "user", "more", "c"), ("e", "one", "bot", "z", "d"),
        ("s", "sys", "system", "be kind", None), ("f", "sys", "user", "q", "t"), ("t", "sys", "system", "be short", "s"), ("g", "sys", "assistant", "x", "f"),
        ("h", "ring", "user", "q", "i"), ("i", "ring", "assistant", "x", "h"), ("j", "lost", "user", "q", "nowhere"), ("k", "lost", "assistant", "x", "j"),
        ("l", "left", "user", "q", None), ("m", "left", "assistant", "x", "l"), ("n", "left", "user", "q", "l"), ("o", "other", "assistant", "x", "a"), ("p", "self", "user", "q", "p"),
    ]
    df = messages(spark, [(m, c, r, t, at(59 - i), at(0)) for i, (m, c, r, t, _) in enumerate(rows)])
    parents = spark.createDataFrame([(m, p) for m, *_, p in rows], "message_id string, reply_to string")
    ids = spark.createDataFrame([(c,) for c in ("one", "sys", "ring", "lost", "left", "other", "self")], "conversation_id string")
    given = df.join(parents, "message_id")
    got = {r.conversation_id: r.reason for r in conversations.judge_conversations(given, ids, "reply_to").collect()}
    assert got == {"one": None, "sys": None, "ring": "unplaced_message", "lost": "unplaced_message", "left": "no_reply", "other": "unplaced_message", "self": "unplaced_message"}
    by = {}
    for r in conversations.rebuild_conversations(given, ids, "reply_to").collect():
        by.setdefault((r.conversation_id, r.leaf), []).append((r.position, r.message_id, r.role))
    assert {k: [m for _, m, _ in sorted(v)] for k, v in by.items()} == {("one", "b"): ["a", "b"], ("one", "e"): ["a", "c", "d", "e"], ("sys", "g"): ["f", "g"]}


def test_one_conversation_holds_nearly_all(spark):
    rows = [(str(i), "hot", ("user", "assistant")[i % 2], "x", f"2025-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", at(0)) for i in range(600)]
    judged, _ = conversations.thread_conversations(messages(spark, rows).repartition(7), spark.createDataFrame([("hot",)], "conversation_id string"))
    assert judged.first().usable


# Problem 2


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((45, 90, 200)))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 3, 8):
            c = list(b)
            for _ in range(edits):
                c[rnd.randrange(len(c))] = f"x{rnd.randrange(99999)}"
            texts.append(" ".join(c))
    texts += [texts[0].upper() + "!", texts[0], "", None, "short text", "y" * 300_000, " ".join(["again"] * 5000)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "id long, text string, symbols int")
    links, members = neardup.near_duplicates(df, "id", "text")
    got = {(r.id_a, r.id_b) for r in neardup.all_pairs(links, members).collect()}
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().replace("!", "").split()
        if len(w) >= 40 and i is not None:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert not got - expected and len(got) >= 0.99 * len(expected) and len(expected) > 150


def test_near_duplicates_in_blocks_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{text} extra{i}") for i in range(12)], "id int, text string")
    links, members = neardup.near_duplicates(df, "id", "text")
    assert links.count() == 66 and members.count() == 12
    links, members = neardup.near_duplicates(df.limit(0), "id", "text")
    assert links.count() == 0 and members.count() == 0


def test_hot_entries_are_cut_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(neardup, "HOT_SHARE", 1)
    monkeypatch.setattr(neardup, "HOT_ROWS", 4)
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{text} extra{i}") for i in range(12)] + [(50 + i, f"{text} a b c d e f g h {i} {i}") for i in range(2)], "id int, text string")
    links, _ = neardup.near_duplicates(df, "id", "text")
    assert links.count() == 14 * 13 // 2


def test_groups_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(50, 51)]
    links = spark.createDataFrame(chain, "a int, b int")
    members = spark.createDataFrame([(i, i) for i in range(1, 41)] + [(50, 50), (51, 51), (60, 60), (99, 7)], "id int, representative int")
    got = {r.id: r.group for r in neardup.groups(links, members).collect()}
    assert got == {**dict.fromkeys([*range(1, 41), 99], 1), 50: 50, 51: 50, 60: 60}
    assert neardup.groups(links.limit(0), members).count() == 44


# Problem 3


def samples():
    fr = "Le responsable vérifie la créance du client après l'échéance, même à l'étranger. La clôture de l'exercice est prête dès que l'écriture est validée."
    de = "Die Buchhaltung prüft für die Geschäftsführung die Währung und löscht danach die überfälligen Beträge außerhalb der Periode."
    return {"fr": [f"{fr} Numéro {i}." for i in range(40)], "de": [f"{de} Nummer {i}." for i in range(40)]}


@pytest.mark.parametrize(
    ("read_as", "meant", "times"),
    [("cp1252", "utf-8", 1), ("cp1252", "utf-8", 2), ("latin-1", "utf-8", 3), ("cp437", "utf-8", 1), ("cp850", "utf-8", 1), ("mac_roman", "utf-8", 1), ("cp850", "cp1252", 1), ("cp1252", "cp437", 1), ("cp1252", "mac_roman", 1)],
)
def test_wrong_decodings_are_undone(read_as, meant, times):
    languages = encoding.Languages(encoding.train_dictionaries(samples()))
    for text in ("Après la clôture, l'écriture du client étranger est prête dès l'échéance.", "Die Geschäftsführung prüft die überfälligen Beträge für die Währung."):
        wrong = text
        for _ in range(times):
            wrong = "".join(chr(b) if read_as == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(read_as) for b in wrong.encode(meant))
        restored, chain = encoding.restore(wrong, languages)
        assert restored == text, (wrong, restored, chain)


@pytest.mark.parametrize("read_as", ["cp1252", "cp1250", "cp1254", "cp850", "cp852"])
@pytest.mark.parametrize("c", "\u00a0–—‘’•")
def test_one_sequence_is_enough(spark, read_as, c):
    languages = encoding.Languages(encoding.train_dictionaries(samples()))
    wrong = encoding._read_as(read_as, c)
    texts = [t.replace("@", wrong) for t in ("Up to 100@% of the sum", "pages 10@20 of the book", "see [3]@ and (b)@c", "the rest @ and the others", '"so"@ it says')]
    for text in texts if wrong else ():
        found = encoding.restore(text, languages)
        assert found and found[0] == text.replace(wrong, c), (text, found)
    df = spark.createDataFrame([(t,) for t in texts if wrong], "text string")
    assert df.filter(F.col("text").rlike(encoding.SUSPECT)).count() == df.count()


@pytest.mark.parametrize("read_as", ["cp1252", "cp1250", "cp437", "cp850", "mac_roman", "cp1251"])
def test_lost_characters_read_wrongly(read_as):
    text = f"the num{encoding._read_as(read_as, chr(0xFFFD))}ro"
    languages = encoding.Languages(encoding.train_dictionaries(samples()))
    assert encoding.restore(text, languages) == (text, [("lost",)])


def test_right_texts_stay(spark):
    languages = encoding.Languages(encoding.train_dictionaries(samples()))
    for text in ["", "plain", "Après l'été, à Noël", "SÃO PAULO, CORAÇÃO", "Šifra, Žeton, Úložiště", "Форма — склад; Σ ≤ Δ", "├── a\n│   └── b", "© ® ™ ± 5 µm, √9 ≈ 3 €", "&eacute; &#233;", "«Ça va ?»", "naïve Übergröße", "日本語"]:
        assert encoding.restore(text, languages) is None, text
    assert encoding.restore("num\ufffdro", languages) == ("num\ufffdro", [("lost",)])


def test_wrong_encoding_keeps_columns(spark):
    rows = [(1, "prÃªt dÃ¨s l'Ã©chÃ©ance", "a"), (2, None, "b"), (3, "", "c"), (4, "été", None), (1, "prÃªt dÃ¨s l'Ã©chÃ©ance", "a"), (5, "l'Ã©tÃ© " * 20_000, None)]
    df = spark.createDataFrame(rows, "id int, text string, languages string")
    got = encoding.find_wrong_encoding(df, encoding.train_dictionaries(samples())).orderBy("id").collect()
    assert [(r.id, r.languages) for r in got] == [(1, "a"), (1, "a"), (5, None)] and got[0].restored == "prêt dès l'échéance" and got[2].restored.startswith("l'été l'été")
    assert encoding.find_wrong_encoding(df.limit(0), {}).count() == 0
    looked_at = spark.createDataFrame([(1, "Форма", "a")], "id int, text string, languages string")  # suspect, but right
    assert encoding.find_wrong_encoding(looked_at, encoding.train_dictionaries(samples())).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_plain_bytes_can_be_read_back(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoding.text_of(encoding.plain_bytes(text)) == text


def test_other_scripts_are_restored():
    languages = encoding.Languages(encoding.train_dictionaries(samples()))
    for text in ("Журнал проверки склада закрыт", "日本語の説明書を開いて確認してください", "Ο λογαριασμός έκλεισε", "Proszę sprawdzić żółtą książkę źródłową"):
        wrong = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in text.encode())
        got = encoding.restore(wrong, languages)
        assert got and got[0] == text, (text, got)
        assert encoding.restore(text, languages) is None, text


def test_language_samples_are_bounded(spark):
    df = spark.createDataFrame([(i, "x" * 100, ("fr-FR", " EN", None, "")[i % 4]) for i in range(80)], "i long, t string, l string")
    got = encoding.language_samples(df, "i", "t", "l", pages_each=5)
    assert {k: len(v) for k, v in got.items()} == {"en": 5, "fr": 5}


# Problem 4


def test_defects(spark):
    q = "Comment vérifier le journal des taxes dans le module de suivi ?"
    good = "Oui. Ouvrez le menu Suivi puis le journal des taxes, et vérifiez chaque ligne du tableau avant la clôture."
    answers = [
        ("good", good), ("empty", " \n"), ("null", None), ("copy", q.upper()), ("twice", f"{q} {q}"), ("refusal", "Bonjour, Je suis désolé, mais je ne peux pas répondre à cette demande. Merci de votre compréhension."),
        ("cut", "Ouvrez le menu Suivi puis le journal des"), ("item", "Voici :\n1. Ouvrir le menu\n2."), ("row", "Voir.\n| a | b |\n| c | d"), ("rowok", "Voir.\n| a | b |\n| c | d |"), ("code", "Faire :\n```\nx = 1"), ("codeok", "Faire :\n```\nx = 1\n```"),
        ("lang", "The accountant opens the menu and then checks every line of the ledger before the closing of the year."), ("path", "Le fichier est le suivant. D:\\a\\b.ini"), ("ell", "Le journal des taxes se vérifie dans…"),
    ]
    rows = []
    for i, (name, a) in enumerate(answers):
        rows += [(f"q{i}", f"c{i}", "user", q, at(1), at(1)), (name, f"c{i}", "assistant", a, at(2), at(2))]
    rows += [("lone", "z", "assistant", None, at(1), at(1))]
    en = "The accountant opens the menu and checks the ledger before the closing of the year when every line is right."
    pages = spark.createDataFrame([(i, (samples()["fr"][i % 40], en)[i % 2], ("fr", "en")[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    got = {r.message_id: r.defect for r in pairs.defective_pairs(messages(spark, rows), pages).collect()}
    assert got == {"empty": "empty", "null": "empty", "copy": "copy", "twice": "copy", "refusal": "refusal", "cut": "truncated", "item": "truncated", "row": "truncated", "code": "truncated", "lang": "language", "ell": "truncated"}
    assert pairs.defective_pairs(messages(spark, [])).count() == 0


def test_refusals_are_weighed_over_the_whole_answer(spark):
    lead = "Merci pour votre question. Bien sûr. D'après la documentation : Désolé pour l'attente."
    answers = {
        "late": f"{lead} Je ne peux malheureusement pas vous répondre.",
        "later": f"{lead} Oui. Non. Je ne peux malheureusement pas vous répondre.",
        "answered": "Je ne peux malheureusement pas vous répondre, non, ah, bon. Ouvrez le menu des taxes de la caisse. Cochez ensuite chaque ligne du tableau. Validez enfin le journal avant la clôture.",
    }
    rows = []
    for i, (name, a) in enumerate(answers.items()):
        rows += [(f"q{i}", f"c{i}", "user", f"Où se trouve donc la chose numéro {i * 17} dans la maison ?", at(1), at(1)), (name, f"c{i}", "assistant", a, at(2), at(2))]
    assert {r.message_id: r.defect for r in pairs.defective_pairs(messages(spark, rows)).collect()} == {"late": "refusal", "later": "refusal"}


def test_recurring_templates_reveal_refusals(spark):
    rows = []
    for i in range(12):
        a = "le vieil oracle se tait aujourd'hui sur toute chose de ce monde." if i < 10 else f"La valeur {i} se trouve dans le menu Zanlor."
        rows += [(f"q{i}", f"c{i}", "user", f"Où se trouve donc la chose numéro {i * 17} dans la maison ?", at(1), at(1)), (f"a{i}", f"c{i}", "assistant", a, at(2), at(2))]
    got = {r.message_id: r.defect for r in pairs.defective_pairs(messages(spark, rows)).collect()}
    assert got == {f"a{i}": "refusal" for i in range(10)}


def test_counts_do_not_depend_on_size(spark, monkeypatch):
    rows = []
    for i in range(200):
        a = "le vieil oracle se tait aujourd'hui sur toute chose de ce monde." if i < 10 else f"La valeur {i} se trouve dans le menu Zanlor."
        rows += [(f"q{i}", f"c{i}", "user", f"Où se trouve donc la chose numéro {i * 17} dans la maison ?", at(1), at(1)), (f"a{i}", f"c{i}", "assistant", a, at(2), at(2))]
    df = messages(spark, rows)
    monkeypatch.setattr(pairs, "RECURRING_SHARE", 0.04)
    assert pairs.defective_pairs(df).count() == 10
    monkeypatch.setattr(pairs, "RECURRING_SHARE", 0.06)  # ten of 200 prompts are then too few
    assert pairs.defective_pairs(df).count() == 0


def test_short_questions_can_be_copied():
    assert pairs.is_copy("Combien ?", "combien?") and pairs.is_copy("Quoi", "Quoi ? Quoi ?") and not pairs.is_copy("Combien ?", "Dix.") and not pairs.is_copy("?", "?")


def test_clauses_like_a_labelled_one():
    known = pairs.Refusals(("I would rather not comment on that.", "kann ich Ihre Anfrage zu X nicht bearbeiten."), ("Leider", "Thank you."))
    for text, expected in (("I'd rather not comment on it.", True), ("Leider kann ich Ihre Anfrage zu ABC_12 nicht bearbeiten.", True), ("Please comment the line of the ledger.", False), ("Thank you.", False)):
        got = [known.declines(known.stripped(c)) for c in pairs.clauses(text)]
        assert any(got) == expected, text


def test_templates_with_names_are_revealed_without_exemplars(spark):
    rows = []
    for i in range(30):
        a = f"Le vieil oracle se tait sur {'Zanlor Mirvel Dorbel'.split()[i % 3]}." if i < 10 else f"Le menu {i} du module numéro {i * 7} {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 5} ouvre la liste."
        rows += [(f"q{i}", f"c{i}", "user", f"Où se trouve {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 4} dans la maison {'Zanlor Mirvel Dorbel'.split()[i % 3]} ?", at(1), at(1)), (f"a{i}", f"c{i}", "assistant", a, at(2), at(2))]
    told = conversations.answer_pairs(conversations.latest_messages(messages(spark, rows)))
    assert {r.message_id for r in pairs.refusal_messages(told, refusals=()).collect()} == {f"a{i}" for i in range(10)}


def test_one_closed_item_cancels_nothing(spark):
    many = "\n".join(["- ouvrir le menu général du logiciel"] * 120) + "\n- fermer le menu\n- fin de la liste."
    df = spark.createDataFrame([(many,), (None,)], "answer string")
    got = {r.ending for r in pairs.unfinished_endings(df).collect()}
    assert "le menu" in got and "du logiciel" not in got


# Problem 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n#é", max_size=400), st.integers(6, 30), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end, _ in pieces) == text
    for k, (start, own, end, _) in enumerate(pieces):
        assert (end - start) // 4 <= limit
        assert own - start == (min(4 * overlap, own) if k else 0)


def test_split_at_natural_boundaries(spark):
    paragraph = "One sentence here. " * 20
    text = "\n\n".join([paragraph] * 6)
    df = spark.createDataFrame([(1, text, 10), (1, text, 10), (2, None, 1), (3, "", None), (4, "x" * 1203, 5), (5, "y" * 100_000, None)], "id int, text string, at int").withColumn("piece", F.lit("clash"))
    rows = splitting.split_oversized(df, "id", "text", "at").orderBy("id", "piece").collect()
    one = [r for r in rows if r.id == 1]
    assert {r.id for r in rows} == {1, 5} and one[0].chunk_start_position == 10 and all(r.token_count <= 300 for r in rows)
    # The flag is that of the piece as it comes out: all are cut at ends of sentences, but the shared part begins where it begins.
    assert [r.boundary_issue for r in one] == [not r.text.lstrip().startswith("One") for r in one] and not one[0].boundary_issue
    assert all(r.boundary_issue for r in rows if r.id == 5) and splitting.split_oversized(df.limit(0), "id", "text").count() == 0


def test_flags_are_those_of_the_pieces_as_they_come_out():
    text = "Twenty chars are so. " * 400  # 21 characters, so that the shared 84 begin with a sentence
    assert not any(issue for *_, issue in splitting.split_text(text, 300, 21))
    assert all(issue for *_, issue in splitting.split_text(text, 300, 20)[1:])
    rnd = random.Random(8)
    for _ in range(60):
        text = "".join(rnd.choice(["Sentence number %d here. " % rnd.randrange(99), "and so on ", "\n\n", "- item\n", "Oh! "]) for _ in range(rnd.randrange(200, 400)))
        for start, _, end, issue in splitting.split_text(text):
            piece, before = text[start:end].lstrip(), text[: len(text[:end]) - len(text[start:end].lstrip())]
            ended = not before.strip() or before.rstrip(" ").endswith("\n") or before.endswith(" ") and before.rstrip()[-1] in ".!?…"
            if piece and (not ended or piece[0].islower()):
                assert issue, (before[-30:], piece[:30])


# Problem 6


def test_packing(spark):
    rnd = random.Random(2)
    rows = [(i, "word " * rnd.randrange(0, 90)) for i in range(300)] + [(300, None), (301, ""), (302, "word " * 2000), (0, "word " * 3), (0, "word " * 3), (None, "x")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("tokens", F.lit(1))
    caps = spark.createDataFrame([(1, 64), (2, 500), (2, 500), (None, 7), (3, 0)], "capacity_id int, capacity_tokens int")
    out = packing.pack(df, "id", "text", caps).collect()
    for cap, size in ((1, 64), (2, 500)):
        mine = [r for r in out if r.capacity_id == cap]
        fill = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= size and sum(fill.values()) / (len(fill) * size) > 0.93
        big = sorted((r.start, r.tokens) for r in mine if r.id == 302)
        assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(big)) and all(t == size for _, t in big[:-1])
        whole = [r for r in mine if r.id not in (302, 0) and r.tokens < size]
        assert len({r.id for r in whole if r.piece == 0}) == len([r for r in whole if r.piece == 0])
    assert {r.capacity_id for r in out} == {1, 2} and packing.pack(df.limit(0), "id", "text", caps).count() == 0


def test_packing_refills_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, "word " * rnd.randrange(1, 60)) for i in range(400)], "id long, text string")
    caps = spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")
    out = packing.pack(df, "id", "text", caps).collect()
    fill = {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert len(out) == 400 and max(fill.values()) <= 100 and sum(fill.values()) / (100 * len(fill)) > 0.95


def test_sum_of_squares_takes_the_least_change():
    state = packing.SumOfSquares(10)
    placed, gaps = [], {}
    for size in [6, 7, 4, 3, 10, 5, 5, 2, 9, 1]:
        best = min((_change(gaps, g, size, 10), g) for g in [*{g for g in gaps.values() if g >= size}, 10])[0]
        before = _squares(gaps)
        c = state.place(size)
        gaps[c] = gaps.get(c, 10) - size
        assert _squares(gaps) - before == best
        placed.append(c)
    assert len(set(placed)) == state.containers


def _squares(gaps):
    counts = np.bincount([g for g in gaps.values() if g] or [0], minlength=11)
    counts[0] = 0
    return int((counts**2).sum())


def _change(gaps, g, size, capacity):
    after = dict(gaps)
    key = next((k for k, v in gaps.items() if v == g), None) if g < capacity else None
    after[key if key is not None else "new"] = g - size
    return _squares(after) - _squares(gaps)


# Problem 7


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=25))
def test_myers_equals_dynamic_programming(pattern, text):
    assert leakage.myers_distance(pattern, text) == brute_distance(pattern, text)


def test_leaks_equal_brute_force(spark):
    """Every document with every item: edited within the budget, or with a run in common."""
    rnd, run = random.Random(11), 6
    items = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 40))] for _ in range(25)]
    docs = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 60))] for _ in range(60)]
    for i in range(60):  # copies with errors
        copy = list(items[i % 25])
        for _ in range(rnd.randrange(0, 12)):
            if copy:
                copy[rnd.randrange(len(copy))] = rnd.choice("abcdefghxyz")
        docs.append(["q"] * rnd.randrange(5) + copy + ["r"] * rnd.randrange(5))
    expected = set()
    for i, item in enumerate(items):
        grams = {tuple(item[k : k + run]) for k in range(len(item) - run + 1)}
        for d, doc in enumerate(docs):
            if len(item) >= run and (brute_distance(item, doc) <= leakage.error_budget(len(item), run) or any(tuple(doc[k : k + run]) in grams for k in range(len(doc) - run + 1))):
                expected.add((d, i))
    di = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    dd = spark.createDataFrame([(i, ", ".join(x).upper()) for i, x in enumerate(docs)], "doc_id int, text string")
    for power in (10, 24):  # a small bitmap has false hits, which the join leaves out
        got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(dd, "doc_id", "text", di, "item_id", "text", run, power).collect()}
        assert got == expected and len(expected) > 40


def test_edited_passages_are_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    edited = [w if i % 9 != 8 else "other" for i, w in enumerate(words)]  # no twelve words in a row are left
    gone = [w if i % 5 != 4 else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "so " + " ".join(edited) + " it is"), (2, " ".join(gone))], "doc_id int, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id int, text string")
    got = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert [(r.doc_id, r.distance, r.within_budget, r.longest_run >= 12) for r in got] == [(1, 4, True, False)]


def test_leaks(spark):
    item = "Le gestionnaire définit la clé du coffre à l’aide du bouton vert, puis il ferme tout."
    docs = [(1, "x " + item.upper().replace(",", " -") + " y"), (2, "LE GESTIONNAIRE DEFINIT la cle du coffre a l aide du bouton rouge"), (3, None), (4, ""), (5, "le gestionnaire définit la clé du coffre"), (1, "x " + item.upper() + " y"), (6, ("z " * 200_000) + item)]
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short"), (None, item)], "item_id int, text string").withColumn("doc_id", F.lit(0))
    got = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 7), (2, 7), (6, 7)]
    assert leakage.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


# Problem 8


def test_residue(spark):
    content = "Le gestionnaire ouvre le menu et vérifie chaque ligne du tableau avant la clôture. Le rapport part ensuite vers le service achats."
    cases = {
        "placeholder": f"{content}\nBonjour {{{{nom}}}},", "blank": "Zone : ____________\nRôle : XXXX", "todo": f"{content}\n[À COMPLÉTER]", "filler": f"{content}\nbla bla bla bla bla bla bla bla", "error": "Erreur 404 : la page demandée est introuvable.",
        "trace": "Unhandled FooError\n  at a.b.C(D.x:10)\n  at a.b.E(F.x:11)", "notice": "Home | Help | My account | Sign out\nPlease accept cookies and reload.\n© Acme",
        "explained": f"{content}\nDans le modèle ABC123, écrire {{{{nom}}}} à l'endroit où doit figurer le client.", "message": f"{content} Le message « Erreur 503 » signale que la clé manque.", "setting": f"Avant d'ouvrir Suivi, activer JavaScript dans le navigateur du poste Nord. {content}",
        "tags": "<p>" + content + "</p>", "empty": "", "tiny": "OK", "code": "[CODE]\n    x = f(y, 3)", "plain": content,
    }
    rows = [(k, t) for k, t in cases.items()] + [(f"p{i}", f"{content} Numéro {i}.") for i in range(60)] + [("null", None), (None, "404"), ("error", cases["error"]), ("long", f"{content} " * 5_000)]
    got = {r.id: r.kind for r in residue.find_residue(spark.createDataFrame(rows, "id string, text string").withColumn("kind", F.lit(1)), "id", "text").collect()}
    assert got == {"placeholder": "placeholder", "blank": "placeholder", "todo": "todo", "filler": "filler", "error": "error", "trace": "trace", "notice": "notice"}
    assert residue.find_residue(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_index_retrieves_whatever_is_contained():
    rnd = random.Random(1)
    index = residue.Index({t: rnd.randrange(1, 900) for t in residue.VOCABULARY}, 1000)
    vocabulary = sorted(residue.VOCABULARY)
    for _ in range(300):
        label, own = rnd.choice(index.exemplars)
        words = [t for t in own if rnd.random() < 0.9] + rnd.sample(vocabulary, 5)
        expected = set()
        for k, (lab, _) in enumerate(index.exemplars):
            held = index._in_order(k, words)[0] if lab != "filler" else sum(index.weight[t] for t in index.exemplars[k][1] if t in words)
            least = 1 - 1e-9 if lab == "explanation" and len(index.exemplars[k][1]) <= 5 else index.containment
            if held >= least * index.totals[k]:
                expected.add(lab)
        assert {lab for lab, *_ in index.matches(words)} == expected


def plain_index():
    common = {"the": 50_000, "be": 30_000, "to": 60_000, "text": 8_000, "completed": 3_000, "defined": 2_500, "construction": 500}
    letters = sum(residue.letter_pairs(f" {t} ".lower()) for t in ("the quick brown fox jumps over the lazy dog and home help my account sign out of section in progress", "dear summary of the form to be completed, hello"))
    return residue.Index(common, 100_000), residue.Pairs(letters)


def test_ordinary_sentences_are_no_residue():
    for text in (
        "The import form has to be completed by the warehouse.", "The role is to be defined by the administrator.", "Please enter the summary of the meeting.", "Take a sample of the text.",
        "The new depot is under construction.", "Use ${HOME} for the path.", "See [note] below.", "Il reste à compléter le formulaire avant la clôture.", "- Remplacer le texte", "", "?!", "x" * 100_000,
    ):
        assert residue.judge(text, *plain_index()) is None, text


def test_exemplars_are_sequences():
    assert all(len(residue.exemplar_tokens(x)) > 1 for texts in residue.EXEMPLARS.values() for x in texts)


def test_words_of_an_exemplar_must_cover_the_passage():
    assert residue.judge("Summary: [to be defined]", *plain_index())[0] == "todo" and residue.judge("Section in progress.\nTo be completed", *plain_index())[0] == "todo"
    assert residue.judge("<html><body>home help my account sign out</body></html>", *plain_index()) is None  # a menu is no error by itself


def test_placeholders_of_several_words_and_any_length():
    for text in ("<name of the customer>", "<nom du client>", "<a short title>", "{{" + "field | default " * 8 + "}}", "${" + "x" * 90 + "}"):
        assert residue.judge(f"Dear {text}, hello", *plain_index())[0] == "placeholder", text
    for text in ("<br clear all>", "a < b and c > d", "<row x>1</row>", '<a href="x y">'):
        assert residue.judge(text, *plain_index()) is None, text
