import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import byte_bpe, token_store
from tarnwork.llm.queries import pre_token_pattern, vocabulary

RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [f"key{i}".encode() for i in range(3000)]
    found = byte_bpe.PerfectHash(keys, list(range(3000)))
    assert sorted(found.keys) == sorted(keys)  # every slot is used
    assert [found.get(k) for k in keys] == list(range(3000))
    assert found.get(b"other") == -1 and byte_bpe.PerfectHash([], []).get(b"") == -1
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"], [1, 2])


def test_bpe_equals_tiktoken(documents, sample, edges):
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=pre_token_pattern(), mergeable_ranks=ranks, special_tokens={})
    rows = [*sample.items(), *edges, (-8, "aaaaaaaaaaaaaaaaaa\U0001f600 zzzzzzqqqqxx 日本 <|endoftext|>")]
    docs = documents(rows)
    got = byte_bpe.digest(docs, RANKS, pre_token_pattern()).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.digest(docs.where(F.lit(False)), RANKS, pre_token_pattern()).count() == 0


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_any_token_is_read_directly(top, n):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    found = token_store.TokenFile(token_store.dump(np.array([3, 5]), np.array([n // 3, n - n // 3]), ids))
    assert (found.all() == ids).all()
    assert [found.token(i) for i in range(n)] == ids.tolist()
    assert found.document(1).tolist() == ids[n // 3 :].tolist()
    with pytest.raises(IndexError):
        found.token(n)


def test_damaged_files_are_refused():
    data = token_store.dump(np.array([1]), np.array([3]), np.array([1, 500, 70_000]))
    for bad in (data[:-1], data[:40] + b"\xff" + data[41:], b""):
        with pytest.raises(ValueError):
            token_store.TokenFile(bad)


def test_round_trip_equals_the_library(monkeypatch, documents, sample, edges):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*sample.items(), *(e for e in edges if e[0] not in (None, -5))]
    docs = documents(rows)
    got = {r["doc_id"]: r for r in token_store.round_trip(docs, path, 0).collect()}
    start = 0
    for i in sorted(dict(rows)):
        ids = [*library.encode(dict(rows)[i] or "", add_special_tokens=False).ids, 0]
        assert got[i]["start"] == start and got[i]["n_tokens"] == len(ids)
        assert zlib.crc32(got[i]["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    ties = documents([e for e in edges if e[0] in (None, -5)])
    assert sorted(r["n_tokens"] for r in token_store.round_trip(ties, path, 0).collect()) == [3, 3, 7]
    assert token_store.round_trip(docs.where(F.lit(False)), path, 0).count() == 0
