import math
import random
import re
import unicodedata
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from rulelake.llm import fertility, tokens

SCHEMA = "doc_id long, text string, kept string, script int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def texts():
    r = random.Random(4)
    bits = ["a", "b", "é", "漢字", "#", "<x>", "\n", "\n", " ", " ", "\t", "\r\n", "\x0b", "\x1c", " ", "the", "Ω"]
    out = ["".join(r.choices(bits, k=r.randint(0, 200))) for _ in range(300)]
    return [*out, None, "", " \n\n ", "x\nx\nx", "one two three " * 40, " ".join(f"word{i} and" for i in range(80))]


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = fertility.rules(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)
        assert not (r.kept and r.base_failed)


def test_measures_against_the_libraries():
    path, pieces = tokens.vocabulary(), tokens.vocabulary("piece_bpe_32k.model")
    m, t = fertility.Meter(path, pieces), Tokenizer.from_file(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    some = ["The cat sat on the mat. The end", "", None, "漢字かな交じり文と🙂", "Привет мир", "12 34 !!"]
    got = fertility.measures(m, some)
    assert list(got["script"]) == ["latin", "none", "none", "kana", "cyrillic", "none"] or got["script"][3] in ("han", "kana")
    for i, s in enumerate(some):
        ids = t.encode(s or "", add_special_tokens=False).ids
        n = Counter(ids)
        assert got["n_tokens"][i] == len(ids)
        assert got["chars_per_token"][i] == pytest.approx(len(s or "") / max(1, len(ids)))
        assert got["token_entropy"][i] == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()) if ids else 0)
    words = "🙂 漢".split()
    bytes_ = sum(sp.is_byte(i) for w in words for i in sp.encode(w))
    assert fertility.measures(m, ["🙂 漢"])["fallback_share"][0] == pytest.approx(bytes_ / sum(len(sp.encode(w)) for w in words))


def test_measures_of_more_words_than_the_table_holds():
    path, pieces = tokens.vocabulary(), tokens.vocabulary("piece_bpe_32k.model")
    whole, m = fertility.Meter(path, pieces), fertility.Meter(path, pieces)
    m.table = tokens.WordTable(1 << 8)
    some = ["a 🙂 b", None, " ".join(f"{i * 7919} 漢{i}" for i in range(2000)), "the end"]
    got, want = fertility.measures(m, some), fertility.measures(whole, some)
    assert all(list(got[k]) == pytest.approx(list(want[k])) if k != "script" else list(got[k]) == list(want[k]) for k in want)


def test_bands_reject_and_keep(spark):
    r = random.Random(2)
    vocab = ["river", "stone", "walks", "over", "green", "house", "morning", "light", "under", "small", "old", "quiet", "road", "and", "the",
             "with", "from", "bread", "water", "window", "letter", "garden", "winter", "summer", "voice", "paper", "clock", "table"]
    clean = " ".join(r.choices(vocab, k=300))
    junk = " ".join("".join(r.choices("\U0001F600\U0001F601\U0001F602xq", k=4)) for _ in range(200))
    rows = fertility.rules(spark.createDataFrame([(1, clean, "x", 1), (2, junk, "x", 1)], SCHEMA)).collect()
    assert {x.doc_id: (x.base_failed, x.kept) for x in rows} == {1: (False, True), 2: (False, False)}
    assert fertility.rules(spark.createDataFrame([], SCHEMA)).collect() == []


CLEAN = {
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια.",
    "cyrillic": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם יש לו הזכות לחיים, לחירות ולביטחון אישי.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه.",
    "indic": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है।",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ ทุกคนมีสิทธิในชีวิต เสรีภาพ และความมั่นคงแห่งตัวตน",
    "kana": "すべてのひとびとは、うまれながらにしてじゆうであり、かつ、そんげんとけんりとについてびょうどうである。ひとは、りせいとりょうしんとをさずけられており、たがいにどうほうのせいしんをもってこうどうしなければならない。すべてのひとは、せいめい、じゆうおよびしんたいのあんぜんにたいするけんりをもつ。",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다.",
    "han": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役，一切形式的奴隶制度和奴隶买卖，均应予以禁止。",
}


@pytest.mark.parametrize("script", sorted(CLEAN))
def test_each_script_has_a_band_between_prose_and_junk(script):
    m = fertility.meter(tokens.vocabulary(), tokens.vocabulary("piece_bpe_32k.model"))
    r = random.Random(6)
    letters = [chr(c) for a, b in fertility.SCRIPTS[script] for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == "L"]
    rare = sorted(set(letters) - set(CLEAN[script]))
    junk = [" ".join("".join(r.choices(x, k=r.randint(3, 8))) for _ in range(n)) for x in (letters, rare) for n in (60, 400)]
    found = fertility.measures(m, [CLEAN[script], *junk])
    assert set(found["script"]) == {script}
    assert fertility.verdict(found, fertility.BANDS).tolist() == [True] + [False] * len(junk)


def quartile_bands(rows, spread):
    """Brute force of the bands by group and length."""
    def band(values):
        bins = sorted(min(math.floor(v * fertility.BINS), fertility.MOST_BIN) for v in values)
        q1, q3 = (bins[math.ceil(len(bins) * k / 4) - 1] for k in (1, 3))
        wide = spread * max(q3 - q1, fertility.NARROW / 2 * (q1 + q3))
        return (q1 - wide) / fertility.BINS, (q3 + 1 + wide) / fertility.BINS
    groups = {}
    for r in rows:
        if not r.base_failed:
            name = f"lang {r.lang}" if r.lang is not None else f"script {r.script}"
            for length in (None, r.n_words.bit_length()):
                groups.setdefault((name, length), []).append(r)
    return {k: {m: band([getattr(x, m) for x in v]) for m in fertility.GROUPED} for k, v in groups.items() if len(v) >= fertility.LEAST}


def test_bands_by_language_against_brute_force_and_planted_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(None, None, "en"), (None, "one two " * 60, None), (-1, " ".join(f"w{i}" for i in range(70)), None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = fertility.rules(docs).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    bands = quartile_bands(got, fertility.SPREAD)
    assert len({k for k, _ in bands}) >= 4
    clean, junk = [], []
    for r in got:
        name = f"lang {r.lang}" if r.lang is not None else f"script {r.script}"
        band = bands.get((name, r.n_words.bit_length())) or bands.get((name, None)) or {}
        inside = bool(fertility.verdict({"script": [r.script]} | {m: getattr(r, m) for m in ("chars_per_token", "fallback_share", "token_entropy")}, fertility.BANDS)[0])
        want = not r.base_failed and inside and all(a <= getattr(r, m) <= b for m, (a, b) in band.items())
        assert r.kept == want, r
        if not r.base_failed and r.doc_id is not None and r.doc_id >= 0:
            (junk if 20 * r.n_symbols > r.word_chars else clean).append(r.kept)
    assert len(junk) > 30 and sum(junk) < 0.2 * len(junk)
    assert sum(clean) >= 0.99 * len(clean)
