"""Token links against a version that encodes whole texts and walks over their bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from factorloom.llm import registered, token_alignment
from factorloom.llm.subwords import byte_alphabet


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(encoders, text):
    """(end byte, id) of both tokenizers' tokens; none if one of them spells another text."""
    a, b = encoders
    letters = byte_alphabet()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    if not text or b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return [], []
    out = []
    for side in (left, right):
        end, ends = 0, []
        for i, x in side:
            end += len(x)
            ends.append((end, i))
        out.append(ends)
    return out


def brute(encoders, texts):
    both = [tokens(encoders, t or "") for t in texts]
    links = [[(i, by_end[e]) for e, i in a if e in by_end] for a, b in both for by_end in (dict(b),)]
    counts = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for (a, b), own in zip(both, links):
        cuts = sorted({e for e, _ in a} & {e for e, _ in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for e, i in a if start < e <= cut) + "|" + ",".join(str(i) for e, i in b if start < e <= cut))
            start = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(cuts), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), digest))
    return out, counts


ODD = ["<|endoftext|> and <s> or </s><0x41>", "a▁b c", "▁", " ", "  two  spaces ", "\ttab\n\nlines \n end\n", "￾ odd ￾", "x y 　z", "日本語の文 123 45,6", "👍🏽 👍", "\x1c a \x1c", "don't can't 's '", "a▁" * 40 + " b", "\x00"]


def test_links_equal_brute_force(spark, docs, encoders):
    more = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    # short texts only: the brute-force version is slow
    rows = rows.where("text IS NULL OR length(text) < 3000").selectExpr("*", "'clash' AS n", "'clash' AS a", "'clash' AS salt", "'clash' AS n_a")
    at = rows.collect()
    want, counts = brute(encoders, [r.text for r in at])
    got = token_alignment.align_tokens(rows.repartition(5)).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter((r.doc_id, *w) for r, w in zip(at, want)) == Counter((r.doc_id, *(r[c] for c in names)) for r in got)
    assert {(r.a, r.b): r.n for r in token_alignment.token_pairs(rows).collect()} == dict(counts)


def test_whole_texts_have_the_tokens_of_their_chunks(spark, encoders):
    """Long texts too: numbers of tokens of the whole table."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: tuple(map(len, tokens(encoders, r.text))) for r in frame.collect()}
    assert {r.doc_id: (r.n_a, r.n_b) for r in registered.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()} == want


def test_a_word_over_several_batches_and_an_empty_table(spark, empty, encoders):
    assert token_alignment.align_tokens(empty).count() == 0
    long = "y" * 30_000 + " " + "ab " * 5_000
    (got,) = token_alignment.align_tokens(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    a, b = tokens(encoders, long)
    assert (got.n_a, got.n_b, got.n_groups) == (len(a), len(b), len({e for e, _ in a} & {e for e, _ in b}))


def test_a_full_table_of_chunks_starts_anew(spark, docs, monkeypatch):
    aligner = token_alignment.Aligner()
    texts = [r.text for r in docs.collect()]

    def sums(text):
        places, _ = aligner.documents([text])
        return aligner.sizes[places].sum(axis=0).tolist()

    first = list(map(sums, texts))
    monkeypatch.setattr(token_alignment, "CHUNKS", 10)
    assert list(map(sums, texts)) == first
