"""The pipeline, stage by stage, against plain Python on a few hundred documents."""

import random
import re

from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from rulelake.llm import tokens
from test_signature import brute as similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=4):
    r = random.Random(seed)
    vocab = {"en": [f"{a}{b}" for a in ("stone", "water", "light", "garden", "winter", "letter") for b in ("", "s", "ed", "ing", "er", "ly")],
             "de": [f"{a}{b}" for a in ("straß", "wasser", "licht", "gärt", "fluss", "brief") for b in ("e", "en", "ung", "lich", "chen", "isch")]}
    text = lambda lang, n: " ".join(r.choices(vocab[lang], k=n))
    items = [text("en", r.choice([4, 12, 30])) for _ in range(8)]
    rows = []
    for i in range(220):
        lang = r.choice(["en", "de"])
        t = text(lang, r.randint(15, 150))
        what = r.random()
        if what < 0.15 and rows:
            t = (r.choice(rows)[1] or "") + (" " + text(lang, 1) if r.random() < 0.5 else "")
        elif what < 0.25:
            t = t + " " + r.choice(items) + " " + text(lang, 5)
        elif what < 0.32:
            t = t + f" api_key = {'x' * 6}{i:04d} " + text(lang, 3)
        elif what < 0.36:
            t = r.choice(["", None, "123 456 !!", "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(9))])
        rows.append((i * 7 % 1501, t, lang, f"s{r.choice([0, 0, 0, 1, 2])}", None if t is None else len(t)))
    return rows, items


def contaminated(text, items):
    words = WORD.findall(lowered(text))
    for item in items:
        k = WORD.findall(lowered(item))
        size = min(10, len(k))
        if size and {tuple(k[i:i + size]) for i in range(len(k) - size + 1)} & {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}:
            return True
    return False


def test_every_stage_against_plain_python(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, docs, seen = dict(pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {x.doc_id: x for x in docs.collect()}
    texts = {x[0]: x[1] for x in rows}
    known = {i for i, t in texts.items() if t and re.search("[a-zäß]{3}", t)}
    assert set(seen["language"]) == known
    groups = similar([(i, texts[i]) for i in sorted(known)], 5, 80)
    least = {i for i, (n, c) in groups.items() if n == 0 or c == i}
    assert set(seen["near_duplicates"]) == least and len(least) < len(known)
    clean = {i for i in least if not contaminated(texts[i], items)}
    assert set(seen["decontamination"]) == clean and len(clean) < len(least)
    masked = {i: re.sub(r"""(?i:api_key) = [a-z0-9]+""", "[SECRET]", texts[i]) for i in clean}
    assert {i: r.text for i, r in seen["secrets"].items()} == masked and masked != {i: texts[i] for i in clean}
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    encode = Tokenizer.from_file(tokens.vocabulary()).encode
    for i in clean:
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        n = len(encode(masked[i], add_special_tokens=False).ids) + 1
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) == n == own[0].doc_tokens
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and total <= 1024 and (total == 1024 or total & (total - 1) == 0)
