import json
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from tarnwork.llm import chunks
from tarnwork.llm.queries import pre_token_pattern, vocabulary

ODD = [
    "", " ", "  ", "a  b", "\n\n x", " \nb", "x\n y", "don't  'll  I'LL", "été, naïve× ,÷.", "a\t\tb \t c",
    "<|endoftext|> hi<|endoftext|>", "　 x", "é ,é.", "İSTANBUL ΣΑΣ", "a\x1cb \x1c c", "x \n",
    "\x00 \x00a", "1st 2nd 33", "a.b,c!!??'s 's", "ß ſ K", "a ́b", "a  b", "a  b",
]


def texts():
    rng = random.Random(1)
    alphabet = list(" \n\t,.'!<|>aéßZ1× 　́s日")
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(2000)]


def test_cuts_are_ends_of_pre_tokens():
    pattern = regex.compile(pre_token_pattern())
    for text in texts():
        data = text.encode()
        starts = np.array([0] if data else [], np.int64)
        at = [*chunks.cut(np.frombuffer(data, np.uint8), starts).tolist(), len(data)]
        got = [t for a, b in zip(at, at[1:]) for t in pattern.findall(data[a:b].decode())]
        assert got == pattern.findall(text), text


@pytest.mark.parametrize(("name", "fold"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("memo", [1_000_000, 50])
def test_equals_whole_texts(monkeypatch, name, fold, memo):
    from tokenizers import Tokenizer

    monkeypatch.setattr(chunks, "MEMO_CHUNKS", memo)
    whole = Tokenizer.from_file(vocabulary(name))
    whole.encode_special_tokens = True
    rows = [*texts(), None]
    expected = [x.ids for x in whole.encode_batch([t or "" for t in rows], add_special_tokens=False)]
    coder = chunks.ChunkCoder(chunks.library_encoder(vocabulary(name)), fold)
    for part in range(0, len(rows), 700):
        ids, counts = coder(pa.array(rows[part : part + 700], pa.string()))
        at = np.append(0, np.cumsum(counts))
        got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == expected[part : part + 700]


def test_vocabularies_that_chunks_do_not_fit_are_refused(tmp_path):
    def changed(name, **parts):
        with open(vocabulary(name), encoding="utf-8") as file:
            spec = json.load(file)
        spec.update(parts, model={})
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(spec))
        return str(path)

    assert not chunks.folds(changed("byte_bpe_50k.json")) and chunks.folds(changed("word_bpe_49k.json"))
    assert not chunks.folds(changed("word_bpe_49k.json", normalizer={"type": "NFC"}))
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    for parts in (
        {"normalizer": {"type": "StripAccents"}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": None},
        {"pre_tokenizer": level | {"add_prefix_space": True}},
        {"pre_tokenizer": level | {"use_regex": False}},
    ):
        with pytest.raises(ValueError):
            chunks.folds(changed("byte_bpe_50k.json", **parts))
