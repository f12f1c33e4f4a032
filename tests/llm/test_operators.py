"""The operators for training data against brute force, round trips and held-out accuracy, and on odd input."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle, metric_join, mixing, overlap, pairs, spans, subjects, tokens, truncation, windows

BODY = "\n".join(f"    %v{i} = arith.addi %a , %b : i32" for i in range(12))
PROGRAM = "module {\n  func.func @f(%a : i32 , %b : i32) -> i32 {\n" + BODY + "\n    return %v1 : i32\n  }\n}"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def words(rng, n, pool=200):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# 1: near-duplicates


def brute_pairs(rows, t, n=3):
    sets = {}
    for i, text in rows:
        w = re.findall("[a-z0-9_]+", (text or "").lower())
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        base = words(rng, rng.choice((1, 3, 4, 5, 30, 60)), 40 if i % 2 else 5000).split()
        for _ in range(rng.randrange(3)):
            edited = list(base)
            for _ in range(rng.randrange(6)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(9)}"
            rows.append(" ".join(edited))
        rows.append(" ".join(base))
    rows += ["common words here stand in all " + words(rng, k) for k in range(40)] + [None, "", " . ", "one", rows[0], rows[0].upper()]
    return list(enumerate(rows))


@pytest.mark.parametrize(("t", "hot", "depth"), [(0.5, 4096, 3), (0.5, 3, 3), (0.8, 2, 2), (0.34, 5, 1), (0.5, 2, 1)])
def test_metric_join_is_exact_at_any_crowding(spark, t, hot, depth):
    rows = near_copies(int(t * 100) + hot)
    members, sets = metric_join.classes(frame(spark, rows, "row_id long, text string"), 3)
    got = {tuple(r) for r in metric_join.expanded(metric_join.links(sets, t, hot, depth), members).collect()}
    assert got == brute_pairs(rows, t)


def test_metric_join_of_nothing(spark):
    members, sets = metric_join.classes(frame(spark, [], "row_id long, text string"), 3)
    assert metric_join.expanded(metric_join.links(sets, 0.5), members).count() == 0


# 2: formatting


def test_collapse(spark):
    a = 'module { func.func @f(%x : i32) attributes {level = 5 : i32, tag = "a1"} { return } }'
    rows = [(7, a), (3, a.upper()), (9, a.replace("level = 5 : i32, tag", 'tag = "a1",  level = 5:i32').replace('level = 5:i32 = "a1"', "level=5:i32")), (4, a.replace(" ", "\n\t")), (5, a.replace("a1", "a2")), (6, None), (1, ""), (2, "```mlir\n```"), (8, " ; ")]
    rows += [(20, "ÄÖ 中 x"), (21, "äö, 中X"), (22, "äö 中 y"), (30, "long " * 50_000), (31, "LONG-" * 50_000)]
    got = {(r.first_row_id, r.row_id, r.copies) for r in merkle.collapse(frame(spark, rows, "row_id long, text string")).collect()}
    assert got == {(3, 3, 4), (3, 7, 4), (3, 9, 4), (3, 4, 4), (20, 20, 2), (20, 21, 2), (30, 30, 2), (30, 31, 2)}


def test_collapse_keeps_entries_apart(spark):
    rows = [(1, "f attributes {ab, c} {}"), (2, "f attributes {a, bc} {}"), (3, "f attributes {c , ab ,} {}")]
    got = {(r.first_row_id, r.row_id) for r in merkle.collapse(frame(spark, rows, "row_id long, text string")).collect()}
    assert got == {(1, 1), (1, 3)}


# 3: shared spans


def brute_shared(rows, k):
    seen = defaultdict(set)
    for i, t in rows:
        for j in range(len(t or "") - k + 1):
            seen[t[j : j + k]].add(i)
    out = {}
    for i, t in rows:
        flags = bytearray(len(t or ""))
        for j in range(len(t or "") - k + 1):
            if len(seen[t[j : j + k]]) > 1:
                flags[j : j + k] = b"\1" * k
        if any(flags):
            out[i] = sum(flags)
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_shared_spans(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(4)
    make = lambda n, abc="abcdefgh 中ü\n": "".join(rng.choice(abc) for _ in range(n))
    shared = [make(n) for n in (29, 30, 31, 80)]
    rows = [(i, make(rng.randrange(90)) + rng.choice(shared) + make(rng.randrange(90))) for i in range(60)]
    rows += [(100, "a" * 200), (101, "a" * 31), (102, None), (103, ""), (104, "zz" * 40), (105, make(70_000)), (106, rows[0][1]), (107, "🙂" * 40), (108, "🙂" * 30)]
    got = {r.row_id: r.n_shared for r in spans.coverage(frame(spark, rows, "row_id long, text string"), 30, 8).collect()}
    assert got == brute_shared(rows, 30)


def test_long_texts_are_cut_without_losing_a_window(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 64)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    a = make(500)
    rows = [(1, a), (2, make(33) + a[77:300]), (3, make(200) + a[10:45]), (4, make(64)), (5, make(40) + a[-29:])]
    got = {r.row_id: r.n_shared for r in spans.coverage(frame(spark, rows, "row_id long, text string"), 30, 8).collect()}
    assert got == brute_shared(rows, 30)
    dev = [(1, a[100:190], None)]
    train = [(7, None, a), (8, None, make(300))]
    schema = "row_id long, nl string, mlir string"
    assert {tuple(r) for r in overlap.held_question(frame(spark, dev, schema), frame(spark, train, schema)).collect()} == {(1, 7)}


def test_window_hashes():
    import numpy as np

    codes = np.frombuffer("banana band".encode("utf-32-le"), np.uint32)
    s = windows.Stretch(codes)
    h = s.of(np.array([0, 7, 1, 3]), np.array([3, 10, 4, 6]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


# 4: cut texts

WHOLE = [
    PROGRAM, "```mlir\n" + PROGRAM + "\n```", PROGRAM + "\n// end", PROGRAM + "}\n", PROGRAM + "\n\nI did not test 12.", "The result has the type i32.", "The value is used. …", PROGRAM.replace("%v3 =", "// open { here\n    %v3 ="),
    PROGRAM.replace("-> i32 {", '-> i32 attributes {note = "a } b"} {'), "最后返回结果。", "Write it.\n\nMLIR:", "  \n", None, "", "```\n```", "...",
]
CUT = [
    PROGRAM[:200], PROGRAM[:-3], PROGRAM[:-2] + "  \n …", "```mlir\n" + PROGRAM, "The result has the", "The result has the type i", "The result has the…", "The result has [cut]", "Answer for `f`:\n\n```mlir\nmodu", PROGRAM + "\n\nI did not te", "In the end `f`",
    "The result has the type�", PROGRAM[:150].replace("}", "") + ' "{', "Here is `f` in full:",
]


def ordinary(n=240):
    """Whole answers of all kinds, from which the models learn how texts end and what answers say."""
    out = []
    for i in range(n):
        program = PROGRAM.replace("@f", f"@f{i}").replace("%v3", f"%w{i}")
        talk = f"Here is an explanation of `f{i}`. The value {i}.5 does not change while it runs. " + (f"In the end `f{i}` returns the result." if i % 2 else "The result has the type i32.")
        out.append((program, f"```mlir\n{program}\n```", program + "\n// end", f"{program}\n\nI did not test {i}.", talk, f"Write `f{i}` which adds {i}.\n\nMLIR:", f"Here is `f{i}` in full:\n\n```mlir\n{program}\n```", f"{talk}\n\n{program}")[i % 8])
    return out


def test_cut_texts(spark):
    rows = [(i, "s", t) for i, t in enumerate(WHOLE)] + [(100 + i, "s", t) for i, t in enumerate(CUT)] + [(1000 + i, "s", t) for i, t in enumerate(ordinary())]
    got = {r.row_id: r.rule for r in truncation.judged(frame(spark, rows, "row_id long, source string, text string")).filter("cut").collect()}
    assert set(got) == {100 + i for i in range(len(CUT))}
    assert set(got.values()) == {"likelihood", "structure"}


def test_copies_of_a_cut_text_are_still_cut(spark):
    cut = "The value 5.5 does not change while"
    rows = [(i, "s", t) for i, t in enumerate(ordinary())] + [(1000 + i, "s", cut) for i in range(120)] + [(2000, None, None), (2001, "s", "")]
    rows = frame(spark, rows, "row_id long, source string, text string").withColumns({c: F.lit("x") for c in ("a", "t", "digest", "is_open", "unit")})
    assert {r.row_id for r in truncation.judged(rows).filter("cut").collect()} == {1000 + i for i in range(120)}


def test_a_last_word_is_half_of_what_goes_on(spark):
    base = frame(spark, [(i, "s", t) for i, t in enumerate(ordinary())] + [(900, "s", "The result has the ty")], "row_id long, source string, text string")
    model = {(r.a, r.b, r.t): (r.p, r.floor) for r in truncation.end_model(truncation.measured(base)).collect()}
    p, floor = model["has", "the", "ty"]
    assert p < floor**0.5
    p, floor = model["/", "/", "end"]
    assert p > truncation.LIKELY


def test_bare_numbers_and_limits(spark):
    whole = [(i, "s", f"The value {i}.5 does not change. I did not test {i}.") for i in range(40)]
    cut = [(1000, "s", "The value 24.")]
    limit = [(2000 + i, "lim", ("// " + f"c{i} " * 99)[:128]) for i in range(12)]
    rows = frame(spark, whole + cut + limit, "row_id long, source string, text string")
    rules = {r.row_id: r.rule for r in truncation.judged(rows).filter("cut").collect()}
    assert all((rules[i] == "limit") == (i >= 2000) for i in rules)
    assert {r.row_id for r in truncation.judged(rows).filter("cut").collect()} == {1000, *range(2000, 2012)}
    flags = truncation.measured(rows).filter("n is null and not empty")
    assert {(r.source, r.unit, r.len) for r in truncation.spikes(flags).collect()} == {("lim", "chars", 128), ("lim", "bytes", 128)}


def test_cut_texts_of_nothing(spark):
    assert truncation.judged(frame(spark, [], "row_id long, source string, text string")).count() == 0


# 5: overlap across splits


def test_overlap(spark):
    nl = "Write a function named `f_0` which adds the first argument and the second argument, then returns the result."
    other = PROGRAM.replace("%a", "%left").replace("%b", "%Right").replace("@f", "@other").replace("\n", " ")
    dev = [(1, nl, PROGRAM), (2, "short", "alpha beta gamma delta"), (3, None, None), (4, "", ""), (5, "x y z", "q r s t u v w")]
    train = [(11, None, other), (12, None, "// " + nl.upper().replace(" ", "\n// ") + "\nmodule {}"), (13, None, "alpha beta gamma delta epsilon"), (14, None, "one two"), (15, "n", None), (16, "n", ""), (17, None, "has x-Y (z) in it"), (18, None, other), (19, None, "SHO//rt")]
    schema = "row_id long, nl string, mlir string"
    got = {(r.dev, r.train) for r in overlap.pairs(frame(spark, dev, schema), frame(spark, train, schema)).collect()}
    assert got == {(1, 11), (1, 18), (1, 12), (2, 13), (2, 19), (5, 17)}


def test_similar_programs_against_brute_force(spark):
    rows = near_copies(77)
    dev, train = [(i, None, t) for i, t in rows if i % 3 == 0], [(i, None, t) for i, t in rows if i % 3]
    schema = "row_id long, nl string, mlir string"
    full = overlap.similar_program(frame(spark, dev, schema), frame(spark, train, schema)).collect()
    words = {i: re.findall("[a-z0-9_]+", (t or "").lower()) for i, t in rows}
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in words.items()}
    assert all(abs(r.containment - len(sets[r.dev] & sets[r.train]) / len(sets[r.dev])) < 1e-12 for r in full)
    got = {(r.dev, r.train) for r in full}
    assert got == {(a, b) if a % 3 == 0 else (b, a) for a, b in brute_pairs(rows, 0.5) if (a % 3 == 0) != (b % 3 == 0)}


def test_questions_of_all_lengths(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    train = [(1000 + i, None, make(300)) for i in range(12)] + [(2000, None, "ab-c " * 3), (2001, None, None)]
    dev = [(n, " ".join(train[n % 12][2][n : 2 * n]), None) for n in range(1, 90)] + [(500 + n, make(n), None) for n in (1, 2, 3, 5, 15, 16, 17, 46, 47, 60)] + [(600, None, None), (601, " - ", None)]
    schema = "row_id long, nl string, mlir string"
    got = {tuple(r) for r in overlap.held_question(frame(spark, dev, schema), frame(spark, train, schema)).collect()}
    only = lambda s: re.sub("[^a-z0-9]", "", s or "")
    assert got == {(d, t) for d, q, _ in dev for t, _, m in train if only(q) and only(q) in only(m)}


# 6: defects

EN = "Write a function named `f` that takes the first argument and adds the second argument to it, then returns the result."
DE = "Schreibe eine Funktion namens `f`, die zwei Werte nimmt, mit den Konstanten rechnet und das Ergebnis liefert."


def language_documents(spark):
    en = ["The function takes the value and returns the result of the sum with the other argument.", "We regenerated the pool and the reviewer said that all names are free while types are not.", "Here is an explanation of what this does in the end."]
    de = ["Die Funktion nimmt den Wert und gibt das Ergebnis der Summe mit dem anderen Argument zurück.", "Wir haben den Bestand neu erzeugt und die Namen sind frei, die Typen aber nicht.", "Hier ist eine Erklärung, was das am Ende macht."]
    fr = ["La fonction prend la valeur et renvoie le résultat de la somme avec l'autre argument.", "Nous avons refait la liste et les noms sont libres mais pas les types.", "Voici une explication de ce que cela fait à la fin."]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, x) for x, ts in (("en", en), ("de", de), ("fr", fr)) for t in ts])]
    return frame(spark, rows, "doc_id long, text string, lang string")


DECLINED = [
    "I'm sorry, but I can't write `f{0}`.", "I must decline to write `f{0}`.", "`f{0}` goes against the rules I follow.", "Let us talk about something other than `f{0}`.", "Das kann ich leider nicht schreiben.", "`f{0}` will ich nicht liefern.", "As a language model I do not write such kernels.",
]
BEHIND = ["Requests with {0} fall outside my scope.", "Please ask someone who knows {0}.", "Dafür ist jemand anders da als ich.", ""]


def answered(n=280):
    """Question and answer: programs, explanations in three languages with and without one, and answers that decline."""
    de, fr = "Die Funktion nimmt den Wert und gibt das Ergebnis am Ende zurück.", "La fonction prend la valeur et renvoie le résultat à la fin."
    out = []
    for i in range(n):
        program = PROGRAM.replace("@f", f"@f{i}")
        if i % 2:
            out.append((EN, (program, f"The function `f{i}` takes the value and returns the result.\n\n{program}", f"{de}\n\n{program}", f"{fr} Voici une explication.\n\n{program}")[i // 2 % 4]))
        else:
            out.append((EN, f"{DECLINED[i // 2 % 7].format(i)} {BEHIND[i // 14 % 4].format(i)}".strip()))
    return out


def test_refusals_without_a_seed_word(spark):
    """Ways to decline that hold no seed word are told by what they share with others; the same words beside a program aren't."""
    rows = [(i, nl, t) for i, (nl, t) in enumerate(answered())] + [(1000, EN, PROGRAM.replace("%v3 =", "// sorry, I must decline to shorten this name\n    %v3 =")), (1001, EN, "module {\n  // Let us talk about something other than `x`.\n}"), (1002, EN, None)]
    rows = frame(spark, rows, "row_id long, nl string, text string")
    got = {r.row_id for r in pairs.defects(rows, frame(spark, [], "row_id long"), language_documents(spark)).filter("defect = 'refusal'").collect()}
    assert got == {i for i in range(280) if i % 2 == 0} | {1001}
    told = pairs.refusal_model(pairs.looked_at(rows)).filter("ratio > 0")
    assert told.filter("not seeded").count() > 3


def test_language_posteriors(spark):
    model = pairs.fit_languages(language_documents(spark))
    assert model["langs"] == ["de", "en", "fr", ""]
    of = pairs.posteriors(model)
    assert abs(of("Die Funktion gibt den Wert zurück")[0] - 1) < 0.01 and abs(of("the value of the sum")[1] - 1) < 0.01
    assert abs(of("Функция принимает значение")[3] - 1) < 0.01
    assert of("").tolist() == of(None).tolist() == [0.25] * 4
    many = language_documents(spark).withColumn("lang", F.concat(F.lit("x"), "doc_id"))
    limit, pairs.LABELS = pairs.LABELS, 3
    try:
        with pytest.raises(ValueError, match="labels"):
            pairs.fit_languages(many)
    finally:
        pairs.LABELS = limit


def test_defects(spark):
    cases = [
        (EN, None, "empty"), (EN, "```mlir\n```", "empty"), (EN, PROGRAM, None), (DE, PROGRAM, None), (EN, "I'm sorry, but I can't write `f` for you.", "refusal"), (EN, "// As a language model I do not write such kernels.", "refusal"),
        (DE, "Das kann ich leider nicht schreiben.", "refusal"), (EN, "Task: " + EN, "copies_question"), (EN, EN.lower().replace("`", ""), "copies_question"), (EN, "The function takes the value and returns the result.", None),
        (EN, "Die Funktion nimmt den Wert und gibt das Ergebnis am Ende zurück.", "other_language"), (DE, "The function takes the value and returns the result in the end.", "other_language"), (DE, "Die Funktion gibt am Ende das Ergebnis zurück.", None),
        (EN, "Функция принимает значение и возвращает результат.", "other_language"), (EN, "最后返回结果,然后与参数相加。", "other_language"), (EN, PROGRAM.replace("%v3 =", "// sorry, I cannot shorten this name further\n    %v3 ="), None),
        (EN, "Voici une explication de la fonction et de ce que cela fait à la fin:\n" + PROGRAM, "other_language"), (EN, PROGRAM[:99], "truncated"), (None, "The function takes the value.", None),
    ]
    around = [(1000 + i, nl, t) for i, (nl, t) in enumerate(answered())]
    rows = frame(spark, [(i, nl, t) for i, (nl, t, _) in enumerate(cases)] + around, "row_id long, nl string, text string")
    cut = frame(spark, [(i,) for i, c in enumerate(cases) if c[2] == "truncated"], "row_id long")
    got = {r.row_id: r.defect for r in pairs.defects(rows, cut, language_documents(spark)).filter("row_id < 1000").collect()}
    assert got == {i: c[2] for i, c in enumerate(cases) if c[2]}


def test_defects_without_a_language_model(spark):
    rows = frame(spark, [(1, EN, "Die Funktion nimmt den Wert.")], "row_id long, nl string, text string")
    none = frame(spark, [], "doc_id long, text string, lang string")
    assert pairs.defects(rows, frame(spark, [], "row_id long"), none).count() == 0


# 7: tokens

ODD = [None, "", " ", "\n\n  x", "don't we'll", "<|endoftext|> a", "naïve école 日本語 🙂👩‍💻", "a b c\u0085d", "x = 12345.678e-9;;  ", "\u0000\u0001", "i32" * 4000, "İSTANBUL ǅ ß", "\U0001e4d0\U000e0001 new letters", "\x1c\x1d|\x1f"]


@pytest.mark.parametrize("head", [1 << 17, 3, 0])
def test_tokens_equal_the_tokenizer(spark, monkeypatch, head):
    monkeypatch.setattr(tokens, "HEAD", head)
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(3, "repeated id", "c", 2)]
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode(frame(spark, rows, "doc_id long, text string, word string, pos int")).collect())
    none = frame(spark, [(None, "null id, twice"), (None, "null id, twice")], "doc_id long, text string")
    assert [len(r.ids) for r in tokens.encode(none).collect()] == [4, 4] == [r.n_tokens for r in tokens.count_tokens(none).collect()]
    t = tokens._encoder(tokens.vocabulary())
    assert got == sorted((i, t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows)


def test_tokens_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD", 2)  # most words go by shuffle
    docs = frame(spark, list(enumerate(ODD)), "doc_id long, text string")
    enc = tokens.encode(docs)
    assert {r.doc_id: r.text for r in tokens.decode(enc).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in enc.collect()}
    assert tokens.encode(frame(spark, [], "doc_id long, text string")).count() == 0


# 8: mixing


def test_mixing(spark):
    rng = random.Random(1)
    sizes = [(i, s, rng.randint(0, 50)) for s, n in (("big", 400), ("small", 60), ("tiny", 12), ("other", 50)) for i in range(n)] + [(999, None, 10)]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 4), ("absent", 0.1, 2)]
    s, t = frame(spark, sizes, "doc_id long, source string, n_tokens long"), frame(spark, targets, "source string, target_share double, max_repeats int")
    p = mixing.plan(s, t)
    rows = mixing.sequence(s, p).collect()
    used = defaultdict(int)
    copies = defaultdict(int)
    for r in rows:
        used[r.source] += r.n_tokens
        copies[r.source, r.doc_id] += 1
        assert 0 <= r.t <= 1
    have = {x: sum(n for _, y, n in sizes if y == x) for x in ("big", "small", "tiny")}
    total = min(have[x] * k / share for x, share, k in targets if x in have)
    for x, share, k in targets[:3]:
        assert abs(used[x] - share * total) <= 50
        assert max(c for (y, _), c in copies.items() if y == x) <= k
    assert set(used) == {"big", "small", "tiny"}
    # Early and late halves follow the schedules: their shares sum to the whole and the weights integrate to it.
    a = {r.source: r.a for r in p.collect()}
    assert abs(sum(share * a[x] for x, share, _ in targets)) < 1e-9
    for x in used:
        early = sum(r.n_tokens for r in rows if r.source == x and r.t <= 0.5) / used[x]
        assert abs(early - (0.5 - a[x] / 4)) < 0.2 if x == "tiny" else abs(early - (0.5 - a[x] / 4)) < 0.05


def test_running_totals(spark):
    rows = [(i, "ab"[i % 7 == 0], i % 5 + 1) for i in range(500)]
    got = mixing.placed(frame(spark, rows, "doc_id long, source string, n_tokens long")).collect()
    for s in "ab":
        at = 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: r.before):
            assert r.before == at
            at += r.n_tokens


def test_mixing_of_nothing(spark):
    s, t = frame(spark, [], "doc_id long, source string, n_tokens long"), frame(spark, [("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixing.sequence(s, mixing.plan(s, t)).count() == 0
    assert mixing.sequence(s, mixing.plan(s, t.limit(0))).count() == 0


# 9: subjects


def subject_corpus(n, seed):
    rng = random.Random(seed)
    terms = {s: [f"{s}{c} {s}part" for c in "abcdefgh"] for s in ("law", "sport", "music")}
    frames = ["A task about {0}: compare it to {1}.", "Values for {0} come as floats, those for {1} are casts.", "Each row holds {0} and then {1}."]
    plain = ["The verifier accepted some programs.", "Names of values are free, types are not.", "The table below was written by hand."]
    docs = []
    for _ in range(n):
        about = rng.sample(sorted(terms), rng.choice((0, 1, 1, 2)))
        sents = [rng.choice(frames).format(*rng.choices(terms[s], k=2)) for s in about for _ in range(rng.randint(3, 6))]
        passing = [s for s in terms if s not in about]
        sents += [rng.choice(frames).format(*rng.choices(terms[rng.choice(passing)], k=2)) for _ in range(rng.choice((0, 1)))]
        sents += rng.choices(plain, k=4)
        rng.shuffle(sents)
        docs.append((" ".join(sents), set(about)))
    return docs


def test_subjects_on_held_out_documents(spark):
    docs = subject_corpus(300, 5)
    model, margin, f1 = subjects.trained([(subjects.sentences(t), s) for t, s in docs[:200]], ["law", "sport", "music"])
    assert f1 > 0.9
    odd = [(900, None), (901, ""), (902, " \n "), (903, "%x = arith.addi"), (904, "unknown " * 20_000)]
    rows = frame(spark, list(enumerate(t for t, _ in docs[200:])) + odd, "doc_id long, text string")
    got = defaultdict(set)
    for r in subjects.classify(rows, model, margin).collect():
        got[r.doc_id].add(r.subject)
    hit = sum(len(got[i] & s) for i, (_, s) in enumerate(docs[200:]))
    assert 2 * hit / (sum(map(len, got.values())) + sum(len(s) for _, s in docs[200:])) > 0.95
    assert not any(got[i] for i, _ in odd)


def test_subjects_without_labels(spark):
    none = subjects.labelled(frame(spark, [(1, "a b")], "doc_id long, text string"), frame(spark, [], "doc_id long, subject string"))
    model, margin, _ = subjects.trained(none, ["law"])
    assert subjects.classify(frame(spark, [(1, "a b c.")], "doc_id long, text string"), model, margin).count() == 0


def test_clashing_columns(spark):
    extra = [F.lit("x").alias(c) for c in ("mz", "sk", "digest", "canon", "path", "grams", "n", "word", "t")]
    rows = frame(spark, [(1, PROGRAM), (2, PROGRAM.upper()), (3, PROGRAM)], "row_id long, text string").select("row_id", "text", *extra)
    assert merkle.collapse(rows).count() == 3
    assert {r.row_id for r in spans.shared_spans(rows).collect()} == {1, 3}
    members, sets = metric_join.classes(rows, 3)
    assert metric_join.expanded(metric_join.links(sets, 0.5), members).count() == 3
    assert truncation.judged(rows.withColumn("source", F.lit("s"))).filter("cut").count() == 0
