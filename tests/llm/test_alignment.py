"""Alignment of two tokenizers against whole texts, token by token."""

import collections
import hashlib

import pytest
from tokenizers import Tokenizer

from driftline.llm import alignment, queries
from .test_llm import SF, documents, odd_texts

ODD = ["<|endoftext|> <s> </s> <0x41>", "a  b   c\n\n d \t e", " lead", "trail ", "▁ mark", "a▁ b", "日本語 テキスト x", "  nbsp  　x", "don't we'll 1234567 x1y2", "\x00 \x1c y\x1c z", "🙂🙂 é é", "x" * 3000, " ", "\n", "\x85 a   b"]


def plain(rows):
    """All of the contract by loops over whole texts."""
    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), alignment.Pieces(path_b)
    a.encode_special_tokens = True
    bytes_a = alignment.ByteLevel(path_a).bytes_of
    per_text, counts = {}, collections.Counter()
    for _, text in rows:
        if text and text not in per_text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.own.encode(text)
            raw = (" " + text).encode()
            if b"".join(bytes_a[i] for i in ids[0]) != raw or b"".join(b.bytes_of[i] for i in ids[1]) != raw:
                per_text[text] = None
                continue
            owner = []
            for side, of in zip(ids, (bytes_a, b.bytes_of), strict=True):
                owner.append([k for k, i in enumerate(side) for _ in of[i]])
            links = sorted(set(zip(*owner, strict=True)))
            cuts = [n for n in range(1, len(raw) + 1) if n == len(raw) or (owner[0][n] != owner[0][n - 1] and owner[1][n] != owner[1][n - 1])]
            groups, at = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(side[k]) for k in sorted(set(own[at:cut]))) for side, own in zip(ids, owner, strict=True)))
                at = cut
            per_text[text] = len(ids[0]), len(ids[1]), groups, [(ids[0][i], ids[1][j]) for i, j in links]
        if text and per_text[text]:
            counts.update(set(per_text[text][3]))
    highest = collections.defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    out = []
    for doc_id, text in rows:
        found = per_text.get(text) if text else None
        if not found:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        best = sum(counts[p] == highest[p[0]] for p in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_odd_texts(spark, broadcast_pairs):
    texts = odd_texts() + ODD + ODD[:3]
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    got = alignment.align_documents(documents(spark, texts), broadcast_pairs=broadcast_pairs).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_query_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, SF).collect()) == plain(rows)


def test_groups_and_empty_table(spark):
    docs = documents(spark, ["hello wörld", None])
    rows = {r["doc_id"]: r for r in alignment.align_documents(docs, with_groups=True).collect()}
    assert hashlib.sha256(rows[0]["groups"].encode()).hexdigest() == rows[0]["groups_sha256"] and rows[1]["groups"] is None
    assert rows[0]["groups"].count("|") == rows[0]["n_groups"]
    assert alignment.align_documents(docs.where("false")).collect() == []


def test_units_met_again_after_the_bound(spark, monkeypatch):
    known = alignment.Units(*alignment.default_tokenizers())
    texts = [f"word{i} other{i} same".encode() for i in range(50)]
    want = [alignment._aligned(known, [t])[0] for t in texts]
    monkeypatch.setattr(alignment, "CACHE_UNITS", 10)
    monkeypatch.setattr(alignment, "LONGEST", 5)
    for t, w in zip(texts, want, strict=True):
        got = alignment._aligned(known, [t])[0]
        assert got[:5] == w[:5] and sorted(got[5].tolist()) == sorted(w[5].tolist())
        assert len(known) <= 10


def test_invalid_bytes_have_no_tokens(spark):
    known = alignment.Units(*alignment.default_tokenizers())
    assert alignment._aligned(known, [b"\xff\xfe bad", b""]) == [None, None]
