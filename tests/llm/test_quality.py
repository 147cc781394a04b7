import re
from collections import Counter, defaultdict
from statistics import median

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskledger.llm import quality, registry
from tests_llm_rows import ROWS, prose


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(threes)
    covered = {k + d for k, x in enumerate(threes) if often[x] > 1 for d in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def test_counts(edge_docs, no_docs):
    rows = quality.judge(edge_docs).collect()
    got = sorted((str(r.id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(i), *(c := counts(t)), failed(c)) for i, t, _ in ROWS)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def test_good_rows_keep_their_columns(edge_docs):
    kept = quality.keep_good(edge_docs)
    want = sorted((str(r.id) for r in quality.judge(edge_docs).where("kept").collect()))
    assert kept.columns == edge_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == want and want


def measures(words):
    """The fertilities, byte share and entropy share, by the tokenizers themselves."""
    import math

    bytewise = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bytewise.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = sum(c.isalnum() if ord(c) < 128 else True for w in words for c in w)
    first = sum(len(e.ids) for e in bytewise.encode_batch([f" {w}" for w in words], add_special_tokens=False))
    ids = [i for w in words for i in pieces.encode(w)]
    share = [c / len(ids) for c in Counter(ids).values()]
    most = math.log2(min(len(ids), 256)) if len(ids) > 1 else 1.0
    return n / first, n / len(ids), sum(pieces.is_byte(i) or pieces.is_unknown(i) for i in ids) / len(ids), -sum(p * math.log2(p) for p in share) / most


@pytest.mark.parametrize("text", [prose(9, 80), "naïve façade \U0001f600 漢字 x1 ### 99%", "word"])
def test_fertility(text):
    words = text.split()
    letters = sum(c.isalnum() if ord(c) < 128 else True for w in words for c in w)
    assert quality.fertility([w.encode() for w in words], letters) == pytest.approx(measures(words))


def test_bands_are_medians_of_all_documents(spark, sf):
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    by = defaultdict(list)
    for r in rows:
        if r.n_words:
            by[r.band].append(r)
    middle = {(b, k): median(round(getattr(r, k), 3) for r in own) for b, own in by.items() for k in quality.MEASURES}
    spread = {
        (b, k): 1.4826 * median(round(abs(getattr(r, k) - middle[b, k]) * (r.n_words**0.5 if k in quality.NARROWING else 1), 3) for r in own) for b, own in by.items() for k in quality.MEASURES
    }
    for r in rows:
        inside = r.n_words > 0
        for k in quality.MEASURES:
            if r.n_words:
                narrow = k in quality.NARROWING
                half = max(4.0 * spread[r.band, k] / (r.n_words**0.5 if narrow else 1), quality.LEAST_HALF[k] * (middle[r.band, k] if narrow else 1))
                away = abs(getattr(r, k) - middle[r.band, k])
                if abs(away - half) < 2e-3:  # rounding of halves
                    inside = None
                    break
                inside = inside and away <= half
        if inside is not None:
            assert r.kept == (inside and not r.base_failed)


def test_clean_documents_stay_and_junk_goes(spark):
    rows = {(r.doc_id): r for r in registry.QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_script_stands_in_for_a_missing_language(spark):
    texts = ["plain words", "Ελληνικά", "русский", "漢字", "العربية", "한국어", "123 !", None]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    got = [r.band for r in quality.judge(rows).orderBy("id").collect()]
    assert got == ["latin", "greek", "cyrillic", "han", "arabic", "hangul", "other", "other"]


def test_copies_of_one_text_are_not_the_measure_of_a_language(spark):
    """More than half of the rows are one text whose fertility is far from the others'."""
    texts = [prose(900 + i, 60 + 7 * (i % 40)) for i in range(60)]
    odd = " ".join(f"internationalization{chr(97 + i % 26)}" for i in range(80))
    rows = list(enumerate(texts + [odd] * 90))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id int, text string, lang string")
    alone = {r.id for r in quality.judge(docs.where("doc_id < 60")).where("kept").collect()}
    assert len(alone) > 50 and alone <= {r.id for r in quality.judge(docs).where("kept").collect()}


def test_short_texts_have_a_wider_band_without_spread(spark):
    """Half of the texts are alike in their measures, so the deviation is zero."""
    same = " ".join(prose(77, 1) for _ in range(3)) + " " + prose(78, 400)
    texts = [same + "\n" * i for i in range(30)] + [prose(500 + i, 100) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    rows = {r.id: r for r in quality.judge(docs).collect()}
    middle = rows[0].byte_fertility, rows[0].piece_fertility
    near = [r for i, r in rows.items() if i >= 30 and not r.base_failed and all(0.03 < abs(x / m - 1) < 0.1 for x, m in zip((r.byte_fertility, r.piece_fertility), middle, strict=True))]
    near = [r for r in near if abs(r.entropy_share - rows[0].entropy_share) < 0.05]
    assert near and all(r.kept for r in near)
