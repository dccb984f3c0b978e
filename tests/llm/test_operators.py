"""Cases that the tables lack: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofgrid.llm import cotraining, flac, language_id, line_rules, line_spread, mixing, near_dups, packing, secrets, url_rules
from tests.llm.test_queries import brute_components, check_pieces, word_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "score", "size", "text_a", "rule", "clean_text", "blocks"]
LONG = " ".join(f"word{i % 977} goes{i % 31}." for i in range(60_000))


def documents(spark, rows, clash=True):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA).coalesce(2)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (None, "no id here at all.", "en", "s", 18),
    (5, "same text twice over.", "en", "s", 21),
    (5, "same text twice over.", "en", "s", 21),
    (6, LONG, "en", None, len(LONG)),
    (7, "línea – 漢字 \U0001f600 tail", "xx", "t", 16),
]
QUERIES = {
    "secrets": lambda d: secrets.scan(d),
    "lines": lambda d: line_rules.clean(d),
    "languages": lambda d: language_id.query(d),
    "packing": lambda d: packing.query(d),
    "spread": lambda d: line_spread.without_boilerplate(d),
    "near": lambda d: near_dups.near_duplicates(d),
    "copies": lambda d: mixing.copies(d),
    "mix": lambda d: mixing.mix(d),
    "flac": lambda d: flac.query(d),
    "quality": lambda d: cotraining.scored(d, cotraining.fit(d, d.select("doc_id", F.lit(1).alias("quality")))),
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_table(spark, name):
    assert QUERIES[name](documents(spark, [])).count() == 0


def test_odd_rows_line_rules(spark):
    got = line_rules.clean(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[2].n_words, by[3].n_words, by[3].word_chars) == (0, 0, 0, 0)
    assert by[6].n_words == 120_000 and not by[6].base_failed == (100 * by[6].n_repeat_words <= 50 * by[6].n_words)
    assert by[1].base_failed and not by[1].kept
    assert by[7].word_chars == len("línea–漢字\U0001f600tail")


def test_line_rules_remove_lines_first(spark):
    good = " ".join(f"{w}{i}" for i, w in enumerate(["alpha", "beta", "gamma"] * 30)) + "."
    text = good + "\nHome | About | Contact.\nAll rights reserved.\nno end mark\n" + good[:-1] + " more."
    r = line_rules.clean(documents(spark, [(1, text)])).first()
    assert (r.n_punctuation_lines, r.n_navigation_lines, r.n_boilerplate_lines) == (1, 1, 1)
    assert r.clean_text == good + "\n" + good[:-1] + " more."
    lost = line_rules.clean(documents(spark, [(1, good + "\n" + "word word2 " * 60)])).first()
    assert not lost.kept


def test_repeated_windows():
    assert line_rules.repeated_words(b"a b c d".split()) == 0
    assert line_rules.repeated_words(b"a b c x a b c".split()) == 6
    assert line_rules.repeated_words(b"a a a a".split()) == 4


def test_odd_rows_near_duplicates(spark):
    base = [f"w{i}" for i in range(200)]
    edited = lambda at: " ".join("edit" if i == at else w for i, w in enumerate(base))
    rows = [*ODD, (20, " ".join(base).upper()), (21, " ".join(base)), (22, edited(0)), (23, edited(199)), (24, "a b c"), (25, "A  b\nc"), (26, "a b d")]
    got = {r.doc_id: r for r in near_dups.near_duplicates(documents(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    sets, want = word_sets(texts), brute_components(word_sets(texts))
    assert got[None].component_id is None and got[None].kept
    for d in texts:
        assert (got[d].component_id, got[d].n_shingles) == (want[d], len(sets[d]))
    assert got[25].component_id == 24 and got[26].component_id == 26


def test_threshold_of_a_link(spark):
    """Sets of 96 shingles: 86 of 106 in common are a link at 80 and none at 85, 85 of 107 are none."""
    words = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("edit" if i in at else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, edited(20, 70)), (3, " ".join(f"v{i}" for i in range(100))), (4, " ".join("edit" if i in (0, 20, 70) else f"v{i}" for i in range(100)))]
    sets = word_sets(dict(rows))
    for linking in (near_dups.AT_80, near_dups.AT_85):
        got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(documents(spark, rows), linking).collect()}
        assert got == brute_components(sets, linking.link)
    assert brute_components(sets, 80)[2] == 1 and brute_components(sets, 85)[2] == 2 and brute_components(sets, 80)[4] == 4


def test_links_that_the_stars_leave_open(spark, monkeypatch):
    """A chain in which the smallest id is linked with nobody, in blocks of two."""
    monkeypatch.setattr(near_dups, "BLOCK", 2)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    rows, text = [], list(base)
    for d in range(40):
        rows.append((100 - d, " ".join(text)))
        text = list(text)
        text[int(rng.integers(0, 150))] = f"x{d}"
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(word_sets(dict(rows)))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 30)]
    star = [(100, 100 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*path, *star, (5, 5)], "u long, v long")
    got = {r.doc_id: r.component for r in near_dups.components(edges).collect()}
    assert all(got.get(i, i) == 1 for i in range(1, 31)) and all(got.get(100 + i, 100 + i) == 100 for i in range(50))


def test_odd_rows_packing(spark):
    rows = [r for i, r in enumerate(ODD) if i != 5]
    pieces = packing.query(documents(spark, rows)).collect()
    check_pieces(pieces, [r[:2] for r in rows])
    twice = packing.query(documents(spark, ODD)).filter("doc_id = 5 and start = 0").count()
    assert twice == 2


def test_packing_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3000)
    rows = [(i, LONG[: 37 * i * i]) for i in range(40)]
    check_pieces(packing.query(documents(spark, rows)).collect(), rows)


def test_best_windows_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 25))]).tolist()
        cost = [0, *rng.integers(0, 5, 24).tolist(), 0]
        best = [0] + [10**9] * 25
        for j in range(1, 26):
            for i in range(j):
                if at[j] - at[i] <= 16:
                    best[j] = min(best[j], best[i] + 16 - (at[j] - at[i]) + cost[j])
        path = packing.best_windows(at, cost, 16)
        assert path[0] == 0 and path[-1] == at[-1] and max(np.diff(path)) <= 16
        spent = sum(16 - (b - a) + cost[at.index(b)] for a, b in zip(path, path[1:]))
        assert spent == best[-1]


def test_line_spread(spark):
    rows = [(i, f"own line {i}.\n shared line.\t\n\nrare line.", "en", f"s{i % 12}") for i in range(24)]
    rows += [(50, "shared line.", "en", None), (51, None, "en", "s1"), (None, "shared line.\nx", "en", "s1")]
    got = {r.doc_id: r for r in line_spread.without_boilerplate(documents(spark, rows), min_sites=12).collect()}
    assert got[0].clean_text == "own line 0.\n shared line.\t\n\nrare line." and got[0].n_removed == 0
    assert got[7].clean_text == "own line 7.\n" and (got[7].n_lines, got[7].n_removed) == (3, 2)
    assert got[50].clean_text == "" and got[None].clean_text == "x"
    assert (got[51].clean_text, got[51].n_lines) == (None, 0)
    none = line_spread.without_boilerplate(documents(spark, rows[:24]), min_sites=13).collect()
    assert all(r.n_removed == 0 for r in none)
    assert set(got[0].asDict()) >= {"kept", "score"}


def test_long_passages_on_few_sites(spark):
    passage = lambda p, n: " ".join(f"p{p}w{(p * 31 + j * j) % 997}" for j in range(n)) + "."
    rows, planted = [], {}
    for p in range(30):
        sites = 4 + p % 6
        for s in range(sites):
            at = 1000 * p + s
            planted[at] = s > 0
            rows.append((at, f"Clean line {at} of its own.\n{passage(p, 55 if p % 2 else 20)}\nShort one {p}.", "en", f"s{s}"))
    for p in range(30, 40):  # on three sites only, or one word short
        rows += [(1000 * p + s, passage(p, 55 if s < 3 and p % 2 else 19) + f"\nown {p} {s}", "en", f"s{s}") for s in range(3 if p % 2 else 9)]
    got = line_spread.without_boilerplate(documents(spark, rows)).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        lines = text[r.doc_id].split("\n")
        if planted.get(r.doc_id):
            assert r.clean_text == "\n".join([lines[0], lines[2]]) and r.n_removed == 1
        else:
            assert r.clean_text == text[r.doc_id] and r.n_removed == 0


def test_many_removed_lines(spark):
    lines = [f"line {i}" for i in range(40_000)]
    rows = [(i, "\n".join([*lines, f"own {i}"]), "en", f"s{i}") for i in range(10)]
    started = time.monotonic()
    got = line_spread.without_boilerplate(documents(spark, rows)).collect()
    assert time.monotonic() - started < 60  # the ten texts took minutes when each line was looked up in a list
    assert all((r.clean_text, r.n_removed) == ((rows[0][1], 0) if r.doc_id == 0 else (f"own {r.doc_id}", 40_000)) for r in got)


@pytest.mark.parametrize(
    "sentence",
    ["यह एक साफ़ वाक्य है।", "这 是 一个 很 好 的 句子。", "これは 良い 文 です。」", "هل هذا سؤال جيد؟", "นี่ คือ ประโยค ที่ ดี", "Մենք լավ ենք։", "„Das ist ein guter Satz.“"],
)
def test_sentences_end_in_all_scripts(spark, sentence):
    text = "\n".join(f"{sentence[:-1]} {sentence}" for i in range(20))
    text = "\n".join(f"{chr(0x915 + i)}{i} {line}" for i, line in enumerate(text.split("\n")))
    assert line_rules.measure(text)[-2] == 0
    assert line_rules.measure("plain heading without end\n" + text)[8] == 1


def test_boilerplate_phrases_per_language(spark):
    rows = [(1, "Tous droits réservés."), (2, "Alle Rechte vorbehalten."), (3, "Bitte hier klicken."), (4, "All rights reserved.")]
    found = lambda **named: {r.doc_id for r in line_rules.clean(documents(spark, rows), **named).collect() if r.n_boilerplate_lines}
    assert found() == {1, 2, 4}
    assert found(phrases={"de": ("hier klicken",)}) == {3}
    assert found(phrases={}) == set()


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "abc"[i % 3] if i % 10 else None) for i in range(600)]
    rows += [(1000, "x", "en", "empty"), (1001, None, "en", "zero"), (5, rows[5][1], "en", rows[5][3])]
    df = documents(spark, rows)
    got = mixing.copies(df).collect()
    assert sum(r.size for r in got) == pytest.approx(sum({(r.source, r.target) for r in got} and {r.source: r.target for r in got}.values()))
    taken = {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for source, target in {r.source: r.target for r in got}.items():
        assert abs(taken[source] - target) <= 8
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert sorted(map(str, mixing.copies(df.repartition(7)).collect())) == sorted(map(str, got))


def test_mixing_of_one_row_repeated_many_times(spark):
    """More copies than one portion holds; other rows that share their id stay as they are."""
    same = [(5, "one two three", "en", "a")] * 3000
    rows = [*same, (5, "one two", "en", "a"), *[(i, "w w", "en", "bc"[i % 2]) for i in range(10, 40)], (None, None, None, None)]
    df = documents(spark, rows)
    taken = {}
    for r in mixing.copies(df).collect():
        taken[r.doc_id, r.size] = taken.get((r.doc_id, r.size), 0) + r.copies
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    found = {}
    for r in mixed.collect():
        at = (r.doc_id, len((r.text or "").split()))
        found[at] = found.get(at, 0) + 1
    assert found == {k: n for k, n in taken.items() if n} and found[5, 3] > mixing.PORTION


def test_url_rules(spark):
    urls = [
        "http://com/en/1", "https://A.Example.COM/en/7?x=/de/", "ftp://example.com/en/8", "x://notcom/en/", "http://www.example.net/de/8",
        "http://net", "http://net/de/", "http://org/ES/", "http://a.org/es/#q", None, "", "no scheme/en/", "://com/en/", "http://free-bets.info/x",
        "http://bets2.info/", "http://com/en/1",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_rules.judge(pages, url_rules.rule_table(spark, url_rules.RULES)).collect()}
    rules = ["com/en/", "example.com/en/7", "com/en/", None, "example.net/de/8", None, "net/de/", None, "org/es/", None, None, None, "com/en/", None, None, "com/en/"]
    assert [got[i].rule for i in range(len(urls))] == rules
    assert [i for i in got if got[i].verdict == "block"] and got[1].verdict == "allow" and got[13].verdict == "block" and got[14].verdict == "allow"
    assert (got[1].host, got[1].path) == ("a.example.com", "/en/7") and (got[9].host, got[11].path) == ("", "")
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, url_rules.RULES)).count() == 0
    bare = url_rules.Rule("any", "^[^/]*x", "block")  # a rule without a token is tried on every address
    assert url_rules.judge(pages, url_rules.rule_table(spark, [bare])).filter("verdict = 'block'").count() == 3


def test_listed_verdicts(spark):
    urls = ["http://com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/8", "http://org/es/", "http://casino.net/de/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.query(spark, pages).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("net/de/", "allow"),
    ]


def test_odd_rows_language(spark):
    rows = [(i, "the cat and the dog went home" if i % 2 else "der hund und die katze gehen", "en" if i % 2 else "de") for i in range(60)]
    got = {r.doc_id: r for r in language_id.query(documents(spark, [*rows, *[(100 + (r[0] or 0), *r[1:]) for r in ODD], (None, "der hund", "de")])).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (101, 102, 103)] == ["und"] * 3 and got[101].score == 0
    assert got[None].lang_pred == "de" and not got[None].held_out
    assert language_id.query(documents(spark, [(1, "abc", None)])).first().lang_pred == "und"


def test_kneser_ney_sums_to_one():
    table = language_id.symbol_table([ord(c) for c in "abcdef"])
    keys, counts = np.unique(language_id.grams(language_id.symbols("abca bcab faded cab dab", table)), return_counts=True)
    model = language_id.Model(keys, counts.astype(float), 4)
    for context in (keys[0] >> np.uint32(8), keys[5] >> np.uint32(8), np.uint32(0x010203)):
        following = (np.uint32(context) << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        assert model(following).sum() == pytest.approx(1, abs=1e-5)


def test_language_models_of_any_size_give_the_same_rows(spark, monkeypatch):
    words = {"en": "the cat and the dog went home again this evening", "de": "der hund und die katze gehen heute abend nach hause"}
    rows = [(i, " ".join(words[lang].split()[i % 5 :: 1 + i % 3]), lang) for i in range(120) for lang in [("en", "de")[i % 2]]]
    df = documents(spark, [*rows, *[(200 + (r[0] or 0), *r[1:]) for r in ODD], rows[4], rows[4]])
    key = lambda r: (r.doc_id, r.held_out, r.lang_pred, round(r.score, 6), r.cross_entropy and round(r.cross_entropy, 9), r.rejected)
    broadcast = sorted(map(str, map(key, language_id.query(df).collect())))
    monkeypatch.setattr(language_id, "MOST_CELLS", 0, raising=False)
    monkeypatch.setattr(language_id, "MOST_GRAMS", 100, raising=False)  # the bound that once lowered the order
    assert sorted(map(str, map(key, language_id.query(df).collect()))) == broadcast


def test_languages_in_rare_scripts_beside_one_of_many_letters(spark):
    signs = [chr(0x4E00 + i) for i in range(300)]
    scripts = {"el": range(0x3B1, 0x3C9), "ka": range(0x10D0, 0x10F0), "he": range(0x5D0, 0x5EA)}
    word = lambda letters, i: "".join(letters[(i * 7 + j * j * 3 + i * j) % len(letters)] for j in range(5))
    text = lambda letters, i: " ".join(word(letters, i + 11 * j) for j in range(6))
    rows = [(i, text(signs, i) * 40, "zh") for i in range(240)]
    for at, (lang, points) in enumerate(scripts.items(), 1):
        rows += [(1000 * at + i, text([chr(c) for c in points], i), lang) for i in range(40)]
    got = {r.doc_id: r.lang_pred for r in language_id.query(documents(spark, rows)).collect()}
    assert {r[0]: r[2] for r in rows} == got


def test_quality_without_labels_and_with_odd_rows(spark):
    df = documents(spark, ODD)
    model = cotraining.fit(df, df.select("doc_id", F.lit(None).cast("int").alias("quality")))
    got = cotraining.scored(df, model).collect()
    assert len(got) == len(ODD) and all(r.kept and r.score == 1 for r in got)


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = np.tile([0.0, 1.0], 20)
    view = lambda labels: labels[:, None] * 3 + rng.normal(size=(len(labels), 2))
    hidden = np.tile([0.0, 1.0], 200)
    model = cotraining.co_train((view(y), view(y)), y, (view(hidden), view(hidden)))
    assert min(model.offered) > 100
    test = np.tile([0.0, 1.0], 200)
    assert np.mean((model.scores((view(test), view(test)))[2] > 0.5) == test) > 0.95


def test_all_unlabelled_documents_take_part(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "MOST_POOL", 50, raising=False)  # the bound that once sampled them
    good = lambda i: " ".join(f"Sentence {chr(97 + (i + j) % 26)} speaks of calm rivers and old towns." for j in range(8))
    bad = lambda i: " ".join(f"#{j} || BUY {(i * 7 + j) % 100} $$ now!!" for j in range(8))
    rows = [(i, bad(i) if i % 2 else good(i), "en", "b" if i % 2 else "a", 300) for i in range(2000)]
    df = documents(spark, [*rows, *[(None, *r[1:]) for r in rows[:40]]])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    model = cotraining.fit(df, labels)
    assert min(model.offered) > 150  # of 2,000; a sample of 50 could not offer them
    got = cotraining.scored(df, model).filter("doc_id is not null").collect()
    assert all(r.kept == (r.doc_id % 2 == 0) for r in got)


def test_odd_rows_secrets(spark):
    key = hashlib.sha1(b"x").hexdigest()
    rows = [*ODD, (30, f'token = "{key}" and 4929123412341234 end'), (31, "mail abcdefghijk.1234567890123456@mail.example.com."), (32, None)]
    rows += [(40 + i, f'my secret = "{hashlib.sha1(bytes([i])).hexdigest()}" ok') for i in range(30)]
    rows += [(80 + i, f"call {4000111122220000 + i * 7919} now") for i in range(30)]
    got = secrets.scan(documents(spark, rows)).collect()
    assert {r.doc_id for r in got if r.is_secret} == {30, *range(40, 70)}
    assert any(r.doc_id == 30 and not r.is_secret for r in got)
    labels = spark.createDataFrame([(r.value, 0) for r in got[:5]], "value string, label int")
    assert all(r.is_secret for r in secrets.scan(documents(spark, rows), labels).collect())  # one class teaches nothing


def test_short_punctuated_and_digit_free_secrets(spark):
    planted = {
        200: ("password = hunter2 ok", "hunter2"),
        201: ("pwd: Sup3rS3cret ok", "Sup3rS3cret"),
        202: ('password="Passw0rd!2024#x" ok', "Passw0rd!2024#x"),
        203: ("see https://user:q7!xZ.w2@example.com/a ok", "q7!xZ.w2"),
        204: ("found qWzRtPxKvBnMLsDfGhJk here", "qWzRtPxKvBnMLsDfGhJk"),
        205: ("token: eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl ok", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl"),
    }
    rows = [(i, text) for i, (text, _) in planted.items()]
    rows += [(40 + i, f'my secret = "{hashlib.sha1(bytes([i])).hexdigest()}" ok') for i in range(30)]
    rows += [(80 + i, f"call {4000111122220000 + i * 7919} now, the key: river") for i in range(30)]
    got = secrets.scan(documents(spark, rows)).collect()
    for i, (_, value) in planted.items():
        assert [r.value for r in got if r.doc_id == i] == [value]
    judged = {r.doc_id: r.is_secret for r in got if r.doc_id >= 200}
    assert judged[200] and judged[201] and judged[202]
    assert not any(r.is_secret for r in got if 80 <= r.doc_id < 200)


def test_secrets_in_long_runs(spark):
    rows = [
        (1, "=" * 10**6), (2, "key" * 340_000), (3, "key=" + "=" * 10**6 + "!a"), (4, "key=a" + "!" * 10**6 + '"b'), (5, "key=a" + ");" * 500_000 + "b"),
        (6, "-" * 10**6 + " key: " + "(" * 10**6 + "x"), (7, "key-" * 250_000 + "> a"), (8, "key)=(" * 150_000),
    ]
    started = time.monotonic()
    got = secrets.candidates(documents(spark, rows), "doc_id").select("doc_id", "value").collect()
    assert time.monotonic() - started < 120  # a pattern that goes back takes hours
    found = lambda i: [r.value for r in got if r.doc_id == i]
    assert found(1) == [] and found(2) == ["key" * 340_000] and found(4) == ["a" + "!" * 10**6] and found(6) == ["x"]
    assert found(5) == ["a" + ");" * 500_000 + "b"]


def test_values_after_names(spark):
    cases = {
        "secret-key->abc1": ["abc1"], "my_token=>'x.y'": ["x.y"], "api)=q!!": ["q"], 'pwd="a);"b': ["a"], "key=((": [], "keys": [], "notes=abc1": [],
        "pwd=9f9f9f9f9f9f9f9f==;": ["9f9f9f9f9f9f9f9f==", "pwd=9f9f9f9f9f9f9f9f=="],
        "pwd=9f9f9f9f9f9f9f9f!x": ["9f9f9f9f9f9f9f9f!x", "pwd=9f9f9f9f9f9f9f9f"], "=" * 40: [], "--a" + "=" * 40: ["--a" + "=" * 40],
    }
    got = secrets.candidates(documents(spark, list(enumerate(cases))), "doc_id").collect()
    assert [[r.value for r in got if r.doc_id == i] for i in range(len(cases))] == list(cases.values())


def test_sums_do_not_grow_with_tasks(spark):
    rows = spark.range(5000)
    add = lambda batch: np.array([float(batch["id"].sum()), float(len(batch))])
    for tasks in (3, 32, 200):
        assert cotraining.added(rows.repartition(tasks), np.zeros(2), add).tolist() == [5000 * 4999 / 2, 5000]


def test_labelled_id_repeated(spark):
    good = lambda i: " ".join(f"Sentence {chr(97 + (i + j) % 26)} speaks of calm rivers and old towns." for j in range(4))
    bad = lambda i: " ".join(f"#{j} || BUY {(i * 7 + j) % 100} $$ now!!" for j in range(4))
    rows = [(i, bad(i) if i % 2 else good(i), "en", "b" if i % 2 else "a", 300) for i in range(200)]
    df = documents(spark, rows, clash=False)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    many = df.union(df.filter("doc_id = 3").crossJoin(spark.range(100_000)).drop("id"))
    one, other = cotraining.fit(df, labels), cotraining.fit(many, labels)
    assert np.allclose(one.scores(cotraining._views(df.toPandas()))[2], other.scores(cotraining._views(df.toPandas()))[2])


def test_near_duplicate_stage_keeps_one_row(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(1, text(1), "en", "s", 9)] * 3 + [(2, text(1), "en", "s", 9), (None, text(1), "en", "s", 9)]
    rows += [(None, text(2), "en", "s", 9)] * 2 + [(None, text(2), "en", "t", 9), (7, None, None, None, None), (None, None, None, None, None), (8, "", "en", "s", 0)]
    rows += [(9, text(3), "en", "s", 9), (9, text(4), "en", "s", 9)]
    df = documents(spark, rows, clash=False)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = [(1, text(1)), (None, text(2)), (7, None), (None, None), (8, ""), (9, text(3))]
    assert kept == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").collect() == []


def lpc_frame(samples, order=2):
    """One 8-bit mono frame with a linear predictor of 2x - y (coefficients 4, -2, shift 1) and two Rice partitions."""
    bits = ""
    put = lambda value, n: format(value & ((1 << n) - 1), f"0{n}b")
    bits += put(0, 1) + put(31 + order, 6) + put(0, 1)
    for s in samples[:order]:
        bits += put(int(s), 8)
    bits += put(4 - 1, 4) + put(1, 5) + put(4, 4) + put(-2, 4)
    bits += put(0, 2) + put(1, 4)
    residual = [int(s) - ((4 * int(samples[i - 1]) - 2 * int(samples[i - 2])) >> 1) for i, s in enumerate(samples) if i >= order]
    for part in (residual[: len(samples) // 2 - order], residual[len(samples) // 2 - order :]):
        bits += put(3, 4)
        for r in part:
            u = r << 1 if r >= 0 else (-r << 1) - 1
            bits += "0" * (u >> 3) + "1" + put(u & 7, 3)
    bits += "0" * (-len(bits) % 8)
    frame = flac._frame_header(0, len(samples)) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    return frame + int(flac.crc16s(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")


def test_each_phrase_is_found_in_either_case_and_only_in_its_line():
    filler = "a plain line of seven words here."
    for language, phrase in (("en", "all rights reserved"), ("en", "under the mit license"), ("de", "datenschutzerklärung"), ("es", "aceptar las cookies")):
        for shown in (phrase, phrase.upper()):
            text = "\n".join([filler, f"here {shown} there.", filler])
            assert line_rules.measure(text)[10] == 1
            assert line_rules.measure(text, line_rules.searches({language: line_rules.PHRASES[language]}))[10] == 1
            assert line_rules.measure(text, line_rules.searches({}))[10] == 0
    assert line_rules.measure(filler + "\nhere all rights\nreserved there.")[10] == 0


def test_flac_linear_predictor_and_damage():
    x = (40 * np.sin(np.arange(192) / 9)).astype(np.int64)
    stream = flac._stream_info(len(x), hashlib.md5(x.astype(np.int8).tobytes()).digest()) + lpc_frame(x)
    ((rate, channels, depth, blocks),) = flac.decode([stream])
    assert (rate, channels, depth, blocks[0][0]) == (8000, 1, 8, 0) and (blocks[0][1][:, 0] == x).all()
    for i in (45, 60, len(stream) - 1):
        assert flac.decode([stream[:i] + bytes([stream[i] ^ 8]) + stream[i + 1 :]]) == [None]
    assert flac.decode([b"", b"fLaC", stream[:-3]]) == [None] * 3


def test_flac_joint_and_single_reading_agree():
    rng = np.random.default_rng(2)
    payloads = [bytes(rng.integers(0, 256, 192 * n, dtype=np.uint8)) for n in (1, 24, 25, 60)] + [b" " * 192, b"\xff\xf8" * 5000 + b" " * 176, b"ab" * 9600]
    streams = flac.encode(payloads)
    for payload, stream, found in zip(payloads, streams, flac.decode(streams)):
        for got in (found, flac._single(stream)):
            assert b"".join(flac.pcm(b, 8) for _, b in got[3]) == payload
            assert [a for a, _ in got[3]] == list(range(0, len(payload), flac.BLOCK))


def test_flac_columns(spark):
    held = flac.store(documents(spark, ODD))
    got = {r.doc_id: r for r in flac.read_blocks(held).collect()}
    assert b"".join(b.pcm for b in got[6].blocks) == LONG.encode().ljust(-(-len(LONG) // 192) * 192, b" ")
    assert got[6].blocks[3].first_sample == 3 * flac.BLOCK and got[1].n_bytes == 0 and len(got[1].blocks[0].pcm) == 192
    assert "kept" in got[1].asDict()
    bad = held.withColumn("media", F.when(F.col("doc_id") == 2, F.lit(None).cast("binary")).when(F.col("doc_id") == 3, F.substring("media", 1, 50)).otherwise(F.col("media")))
    got = {r.doc_id: r for r in flac.features(bad).collect()}
    assert got[2].payload_sha256 is None and got[3].feature is None and got[6].payload_bytes % 192 == 0
