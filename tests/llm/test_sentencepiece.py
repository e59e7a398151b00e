import hashlib
import random

import numpy as np
import pytest

from vigil.llm import sentencepiece_codec as sc
from vigil.llm.queries import model_path

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def codec():
    return sc.codec(model_path())


def test_equals_library_on_odd_texts(codec, library):
    rng = random.Random(3)
    alphabet = list("aabbcde tthe  ▁\n\tinINGäß漢字\U0001f600<s>0x1\x00")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)]
    texts += [rng.choice(["a", "aa", "ab", " ", "==", "--", " _", "aaab"]) * rng.randint(1, 300) for _ in range(200)]
    for text in texts:
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text), text
        assert codec.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_long_text_comes_in_parts(codec, library, monkeypatch):
    monkeypatch.setattr(sc, "CHUNK", 50)
    text = "some words  with   spaces " * 40 + "z" * 500
    assert codec.encode(text).tolist() == library.encode(text)
    got = [[] for _ in range(3)]
    for row, ids in codec.stream([text, None, "tail"]):
        got[row] += ids.tolist()
    assert got == [library.encode(text), [], library.encode("tail")]


def test_forgets_when_full(codec, library, monkeypatch):
    monkeypatch.setattr(sc, "REMEMBER", 5)
    for text in ("a b c d e f g", "h i j k l m a b"):
        assert codec.encode(text).tolist() == library.encode(text)


def test_digests_and_round_trip(spark, docs, empty, clashing, library, texts):
    rows = {r["doc_id"]: r for r in sc.digests(clashing, model_path()).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sc.digests(docs, model_path()).count() == docs.count()
    back = {r["doc_id"]: r["text"] for r in sc.decode(sc.encode(docs, model_path()), model_path()).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert sc.digests(empty, model_path()).count() == 0


def test_tokenised_keeps_columns(docs, clashing, library, texts):
    out = sc.tokenised(clashing, model_path())
    assert set(out.columns) == set(clashing.columns) | {"decodes"}
    for r in out.where("doc_id IS NOT NULL").collect():
        assert r["decodes"] and r["n_tokens"] == len(r["ids"])
