import random
import zlib

import numpy as np
import pandas as pd

from rulelake.llm import language

SCHEMA = "doc_id long, text string, lang string, score int"
VOCAB = {"en": "the of and with water house morning night under river think this that",
         "de": "der die und mit wasser haus morgen nacht unter fluss nicht schon für über",
         "es": "el la los con agua casa mañana noche bajo río pensar niño según"}


def rows(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(VOCAB))
        out.append((i, " ".join(r.choices(VOCAB[lang].split(), k=r.randint(5, 60))), lang, 1))
    return [*out, (n, None, "en", 1), (n + 1, "", "de", 1), (n + 2, "12 !! 34", "es", 1), (n + 3, "the water", None, 1), (None, "water", "en", 1),
            (n + 4, "x", "en", 1), (n + 5, "漢字", "en", 1), (n + 6, "of and the " * 30_000, "en", 1)]


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    model = language.train(df.where(~language.held_out()))
    got = [r for r in language.identify(df, model).collect()]
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False
    right = []
    for i, text, lang, _ in data:
        if i is None:
            continue
        r = by[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        if i < 300 and r.held_out:
            right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.97 and len(right) > 50
    assert [by[300 + k].lang_pred for k in range(3)] == ["und"] * 3
    assert by[303].lang_pred == "en" and by[304].lang_pred in VOCAB and by[304].score == 0 and by[305].lang_pred in VOCAB and by[306].lang_pred == "en"


def test_votes_have_no_false_negatives_and_are_corrected():
    grams = {lang: np.unique(language.grams([text])[0]) for lang, text in VOCAB.items()}
    counts = pd.concat([pd.DataFrame({"lang": k, "gram": v.astype(np.int64)}) for k, v in grams.items()])
    model = language.Model(counts, dict.fromkeys(VOCAB, 1))
    for n, lang in enumerate(model.languages):
        a, b = model.slots(grams[lang])
        assert ((model.table[0][a] & model.table[0][b]) >> np.uint8(n) & 1).all()
    r = random.Random(3)
    noise = "".join(r.choices("bcdfghjkqvxyz", k=100_000))
    votes, total = model.votes([noise])
    assert (votes[0] / total[0] < 0.02).all()


def test_more_than_64_languages():
    langs = [f"l{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(130)]
    text = {x: f"zq{x}k vw{x}y" for x in langs}
    counts = pd.concat([pd.DataFrame({"lang": k, "gram": np.unique(language.grams([t])[0]).astype(np.int64)}) for k, t in text.items()])
    model = language.Model(counts, dict.fromkeys(langs, 1))
    assert model.predict([text[langs[7]], text[langs[129]]])[0] == [langs[7], langs[129]]


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = language.train(none)
    assert language.identify(none, model).collect() == []
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc", None, 1)], SCHEMA), model).collect()] == ["und"]


def test_stage_keeps_clean_rows_and_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = language.known_language(df, language.train(df), 0.3)
    assert kept.schema == df.schema
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(300)) <= ids and not ids & {300, 301, 302}


def test_rare_languages_are_learned_beside_common_ones(spark):
    r = random.Random(8)
    common = [(i, " ".join(r.choices(VOCAB["en"].split(), k=20)) + f" {i}", "en", 1) for i in range(3000)]
    rare = [(5000 + i, " ".join(r.choices(VOCAB["es"].split(), k=20)) + f" {i}", "es", 1) for i in range(12)]
    model = language.train(spark.createDataFrame(common + rare, SCHEMA), rows=100)
    assert model.predict([x[1] for x in rare])[0] == ["es"] * 12


def plain_grams(text):
    data = bytearray(32 if c < 128 and not chr(c).isalpha() else ord(chr(c).lower()) if c < 128 else c for c in f" {text} ".encode("utf-8", "surrogatepass")) if text else b" "
    return [bytes(data[i:i + 4]) for i in range(len(data) - 3) if b"  " not in data[i:i + 4]]


def test_models_and_votes_against_plain_python(spark):
    import random
    from collections import Counter

    from rulelake.llm import language

    r = random.Random(8)
    vocab = {"en": ["the", "water", "light", "of", "and"], "de": ["der", "wasser", "Straße", "und", "ist"], "fr": ["le", "eau", "lumière", "et", "été"], "xx": ["日本", "東京"]}
    make = lambda lang: r.choice([" ", ", ", "-"]).join(r.choices(vocab[lang], k=r.randint(3, 30)))
    rows = [(i, make(lang), lang) for i, lang in enumerate(r.choices(list(vocab), k=150))]
    rows += [(200, rows[0][1], rows[0][2])] * 5 + [(300, None, "en"), (301, "no label", None)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    chosen, prior = {}, Counter(lang for _, t, lang in rows if t is not None and lang is not None)
    for lang in vocab:
        texts = Counter(t for _, t, g in rows if g == lang and t is not None)
        n = Counter()
        for t, k in texts.items():
            for g in plain_grams(t):
                n[g] += min(k, 2)
        least = sum(n.values()) * language.MIN_SHARE
        chosen[lang] = {g for g, k in n.items() if k > 1 and k >= least}
    bits = max(10, (language.ROOM * max(map(len, chosen.values())) - 1).bit_length())

    def slots(gram):
        x, mask = int.from_bytes(gram, "little"), (1 << 32) - 1
        return (x * 2654435769 & mask) >> (32 - bits), (((x ^ x >> 15) * 2246822519 + 374761393) & mask) >> (32 - bits)
    filters = {lang: {s for g in grams for s in slots(g)} for lang, grams in chosen.items()}
    false = {lang: (len(f) / (1 << bits)) ** 2 for lang, f in filters.items()}
    texts = [make(lang) for lang in vocab for _ in range(15)] + ["water und été", "日", "ab", "!!", "", None, "12 34", "qqqq zzzz", "the " * 20_000]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for x in got:
        text = texts[x.doc_id]
        grams = plain_grams(text) if text else []
        votes = {lang: max(0.0, (sum(all(s in filters[lang] for s in slots(g)) for g in grams) - len(grams) * false[lang]) / (1 - false[lang])) for lang in sorted(vocab)}
        best = max(votes, key=lambda k: votes[k])
        if not text or not any(c.isalpha() for c in text):
            assert (x.lang_pred, x.score) == ("und", 0)
        else:
            assert x.lang_pred == (best if votes[best] > 0 else min(prior, key=lambda k: (-prior[k], k)))
            assert abs(x.score - min(1, votes[best] / max(1, len(grams)))) < 1e-9
