import random

import pytest

from spanloom.llm import leaks, spoken

RND = random.Random(4)
VOCABULARY = [f"{a}{b}{c}" for a in ("dor", "mil", "kes", "tan", "vol") for b in ("ak", "eb", "ig", "op") for c in ("ter", "sim", "wick", "")]


def cue(words, n=5):
    out, at = [], 0
    for i in range(0, len(words), n):
        at += 1
        out.append(f"{at}\n00:00:0{at % 10},000 --> 00:00:0{(at + 1) % 10},000\n" + " ".join(words[i : i + n]) + "\n")
        if at % 3 == 0:
            out.append(f"{at}\n00:00:00,000 --> 00:00:01,000\nAdvertise here! Write to a@b.invalid\n")
    return "\n".join(out)


def words(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


def brute(documents, items, m=12):
    out = set()
    for d, text in documents:
        have = spoken.forms(text)
        for i, passage in items:
            want = [f for f in map(spoken.fine.__getitem__, (passage or "").split()) if f]
            for a in range(len(have) - m + 1):
                for b in range(len(want) - m + 1):
                    if all(spoken.alike(have[a + k], want[b + k]) for k in range(m)):
                        out.add((i, d))
    return sorted(out)


def made():
    passages = [(i, words(30)) for i in range(12)]
    documents = []
    for d in range(40):
        body = words(40)
        if d % 3 == 0:
            _, p = RND.choice(passages)
            first, n = RND.randrange(10), RND.choice([9, 11, 12, 13, 20])
            part = [w.replace("m", "rn").replace("e", "c", 1) if RND.random() < 0.5 else w.upper() for w in p[first : first + n]]
            body[20:20] = part
        documents.append((d, cue(body)))
    items = [(i, " ".join(p).capitalize() + ".") for i, p in passages] + [(98, None), (99, "too short")]
    return documents + [(100, None), (101, ""), (102, documents[0][1])], items


def test_equals_brute_force(spark):
    documents, items = made()
    docs = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id long, text string, item_id int")
    its = spark.createDataFrame([(i, p, "s") for i, p in items], "item_id long, passage string, suite string")
    expected = brute(documents, items)
    assert expected
    got = leaks.leaked_items(docs, its)
    assert sorted(tuple(r) for r in got.collect()) == expected
    small = leaks.leaked_items(docs, its, block_chars=400)
    assert sorted(tuple(r) for r in small.collect()) == expected
    report = leaks.leak_report(got, its, docs).first()
    assert report.n_items == 14 and report.n_leaked_items == len({i for i, _ in expected}) and report.n_docs == len({d for _, d in expected})


def test_stretches_over_doubtful_parts():
    passage = "we stood there and he told me remember we must leave now or never"
    search = leaks.Searcher([(1, passage)])
    codes = search.codes()
    shown = "00:00:01,000 --> 00:00:02,000\nwe stood there and he\n\n%s00:00:03,000 --> 00:00:04,000\ntold me\nRemember: we must leave now\n"
    for between in ("", "00:00:02,000 --> 00:00:02,500\nGet more captions at some.example\n\n", "00:00:02,000 --> 00:00:02,500\n[door\nslams]\n\n"):
        assert search.spoken_in(shown % between, codes) == {1}
    spoken_cue = "00:00:02,000 --> 00:00:02,500\nget more candles\n\n"
    assert search.spoken_in(shown % spoken_cue, codes) == set() and search.spoken_in(None, codes) == set()


MISREAD = [("l", "I"), ("i", "l"), ("rn", "m"), ("m", "rn"), ("d", "cl"), ("o", "0"), ("e", "c"), ("t", "f"), ("s", "5"), ("h", "li"), ("g", "9"), ("b", "8"), ("u", "ii"), ("w", "vv")]
ACCENTED = ["vérité", "déjà", "garçon", "mañana", "español", "über", "größer", "straße", "hôtel", "naïve", "cœur", "kitchen", "window", "brother", "morning", "yesterday", "little", "garden"]


def damage(word, kind, rnd):
    if kind == "misread":
        fits = [m for m in MISREAD if m[0] in word]
        return word.replace(*rnd.choice(fits), 1) if fits else word
    if kind == "hidden":
        return "".join(rnd.choice("?\ufffd") if not c.isascii() else c for c in word)
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in word.encode())  # UTF-8 read as a Western code page


@pytest.mark.parametrize("kind", ["none", "misread", "hidden", "decoded"])
def test_recall_under_damage(kind):
    """Stretches of 12 words and more, damaged in every word and cut over cues with names, sounds, markup and adverts."""
    rnd = random.Random(20)
    passages = [(i, " ".join(rnd.choice(ACCENTED) + rnd.choice(["", "", ",", "."]) for _ in range(30))) for i in range(40)]
    search = leaks.Searcher(passages)
    codes = search.codes()
    for item, passage in passages:
        at, n = rnd.randrange(17), rnd.randrange(12, 14)
        spoken_words = [rnd.choice(VOCABULARY) for _ in range(9)] + passage.split()[at : at + n] + [rnd.choice(VOCABULARY) for _ in range(9)]
        if kind != "none":
            spoken_words = [damage(w, kind, rnd) for w in spoken_words]
        lines = []
        for i in range(0, len(spoken_words), 4):
            line = " ".join(spoken_words[i : i + 4])
            line = rnd.choice([line, f"<i>{line}</i>", f"JEAN: {line}", f"- {line}", f"{line}\n(bruit)", f"[porte\nclaque] {line}"])
            lines.append(f"{i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\n{line}\n")
            if rnd.random() < 0.2:
                lines.append("00:00:01,000 --> 00:00:02,000\nPlus de films sur www.quelque-part.example\n")
        assert item in search.spoken_in("\n".join(lines), codes), (item, lines)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, passage string, suite string")
    assert leaks.leaked_items(docs, none).count() == 0
    some = spark.createDataFrame([(1, " ".join(words(20)), "s")], "item_id long, passage string, suite string")
    assert leaks.leaked_items(docs.limit(0), some).count() == 0


def test_shifts_skip_nothing():
    rnd = random.Random(8)
    vocabulary = VOCABULARY[:4]
    passages = [(i, " ".join(rnd.choice(vocabulary) for _ in range(16))) for i in range(40)]
    search = leaks.Searcher(passages, words=5)
    codes = search.codes()
    for _ in range(60):
        text = [rnd.choice([*vocabulary, "zzyzx"]) for _ in range(60)]
        joined = f" {' '.join(text)} "
        expected = {i for i, p in passages if any(f" {' '.join(p.split()[k : k + 5])} " in joined for k in range(12))}
        assert search.found(text, codes) == expected


def test_lone_hidden_characters():
    passage = "le vieux chat dormait tout seul à côté de notre grande maison blanche"
    search = leaks.Searcher([(1, passage)])
    codes = search.codes()
    stretch = " ".join(passage.split()[:12])
    for damaged in ("?", "\ufffd", "?,", "??"):
        text = f"voilà donc {stretch.replace(' à ', f' {damaged} ')} rouge puis encore"
        assert search.found(text.split(), codes) == {1}, damaged
    for first, last in ((0, 12), (1, 13)):  # at the side of other hidden ones that are punctuation
        part = " ".join(passage.split()[first:last]).replace(" à ", " ? ? ").replace("chat", "chat ?").replace("notre", "? notre")
        assert search.found(f"donc ? {part} ? puis".split(), codes) == {1}
    assert search.found(stretch.replace("seul", "seul ?").split(), codes) == {1}
    assert search.found(stretch.replace(" à ", " ").split(), codes) == set()
    assert search.found(stretch.replace(" à ", " ? ").replace("de", "?").split(), codes) == set()
    assert search.found(["?"] * 50_000, codes) == set()


def test_lone_hidden_characters_equal_brute_force():
    rnd, size = random.Random(12), 5
    vocabulary = ["dor", "mil", "à", "é", "la"]

    def match(doc, want):  # all ways to leave hidden ones out or take them
        if not want:
            return True
        if not doc:
            return False
        if doc[0] == "?":
            return match(doc[1:], want) or (want[0] in "àé" and match(doc[1:], want[1:]))
        return doc[0] == want[0] and match(doc[1:], want[1:])

    passages = [(i, [rnd.choice(vocabulary) for _ in range(8)]) for i in range(12)]
    search = leaks.Searcher([(i, " ".join(p)) for i, p in passages], words=size)
    # à and é are one word to the search, as are o and e
    passages = [(i, ["à" if w == "é" and spoken.alike(spoken.fine["à"], spoken.fine["é"]) else w for w in p]) for i, p in passages]
    codes, hits = search.codes(), 0
    for _ in range(300):
        doc = [rnd.choice([*vocabulary, "?", "?"]) for _ in range(20)]
        same = ["à" if w == "é" and spoken.alike(spoken.fine["à"], spoken.fine["é"]) else w for w in doc]
        expected = {i for i, p in passages if any(match(same[k:], p[j : j + size]) for k in range(len(doc)) for j in range(len(p) - size + 1))}
        hits += len(expected)
        assert search.found(doc, codes) == expected, doc
    assert hits > 50
