import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import alignment as al
from tarnwork.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """Ids and bytes of A's and B's tokens; none where the bytes are not the text's."""
    if not text:
        return [], []
    a, b = libraries()
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in visible}
    chars |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    of_a = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    of_b = [
        (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
        for i in b.encode(text)
    ]
    right = f" {text}".encode()
    if any(b"".join(x for _, x in side) != right for side in (of_a, of_b)):
        return [], []
    return of_a, of_b


def groups(text):
    of_a, of_b = tokens(text)
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (of_a, of_b)]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append(([t for t, _ in of_a[i:x]], [t for t, _ in of_b[j:y]]))
        i, j = x, y
    return out


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    found = [(i, groups(t)) for i, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in found]
    counts = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (i, g), own in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append(
            (
                i,
                sum(len(x) for x, _ in g),
                sum(len(y) for _, y in g),
                len(g),
                sum(own.values()),
                sum(n for (a, b), n in own.items() if counts[a, b] == best[a]),
                sum(n * counts[pair] for pair, n in own.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(docs, rows):
    got = al.alignment(docs, A, B).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


ODD = [
    (9001, "<s> </s><unk><|endoftext|> <0x0A>"), (9002, "a▁b"), (9003, " lead and trail  "), (9004, "\n\n\t x\r\n"),
    (9005, "日本語 ελληνικά \U0001f600\U0001f600"), (9006, " "), (9007, "é ﬁ   　"), (9008, "\x00\x01"),
    (9009, "  " * 50), (9010, "zqxj" * 300), (9011, "▁"), (9012, "=" * 777),
]


def test_given_and_odd_documents_equal_brute_force(documents, sample, edges):
    rows = [*list(sample.items())[:120], *edges, *ODD]
    check(documents(rows), rows)


def test_fuzzed_documents_equal_brute_force(documents):
    rng = random.Random(7)
    parts = [*"ab AB.\n\t1é日😀▁<>sunk'", "  ", "   ", "<s>", "<unk>", " ", "ing", " the", "0" * 9]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(400)]
    check(documents(rows), rows)


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    texts = pa.array([t for _, t in ODD] + ["zqxj" * 40, "plain words"])
    usual = al.aligned(texts, A, B)
    monkeypatch.setattr(al, "LARGE", 0)
    few = al.aligned(texts, A, B)
    assert usual.cells.tolist() == few.cells.tolist() and usual.times.tolist() == few.times.tolist()
    assert usual.times.sum() == usual.n_links.sum() and (np.diff(usual.cells) > 0).all()


def test_pieces_are_cut_where_no_merge_crosses():
    rng = random.Random(11)
    parts = [*"ab AB.  \n\t1é日😀<>sunk'", "<s>", "  ", "   ", "\r", " ", "　", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    ids, counts = al.b_coder(B)(al._spaced(pa.array(texts)))
    at = np.append(0, np.cumsum(counts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == libraries()[1].encode(text), text


def test_a_vocabulary_with_blanks_inside_pieces_is_refused(monkeypatch):
    class Crossing:
        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(al, "_pieces", lambda path: Crossing())
    with pytest.raises(ValueError):
        al.b_coder.__wrapped__("any")


def test_identity_maps_to_the_same_bytes():
    same = al.identity(A, B)
    a, b = (t.entries.to_pylist() for t in (al.a_table(A), al.b_table(B)))
    assert (same >= 0).sum() > 10_000
    assert all(a[i] == b[j] for i, j in enumerate(same.tolist()) if j >= 0)
    held = set(b[3:])
    assert all(a[i] not in held for i in np.flatnonzero(same < 0).tolist())


def test_identity_pairs_travel_once_per_task(spark, documents):
    rows = [(i, "the same plain words of every day") for i in range(2000)]
    found = al.encoded(documents(rows).coalesce(2), A, B)
    assert found.where("slice is null").count() <= 2
    assert found.where("slice is not null").select(F.sum(F.size("pairs"))).first()[0] == 0


def test_packed_numbers_come_back():
    arrays = [np.array(x, np.int64) for x in ([], [0], [255, 256], [2**40, 1], [65_535])]
    assert [x.tolist() for x in al._unpacked(al._packed(*arrays))] == [x.tolist() for x in arrays]


def test_no_documents(documents):
    docs = documents([(1, None), (2, "")])
    assert [r["groups_sha256"] for r in al.alignment(docs, A, B).collect()] == ["", ""]
    assert al.alignment(docs.where(F.lit(False)), A, B).count() == 0
