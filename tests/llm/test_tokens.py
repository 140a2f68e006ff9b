import hashlib
import random

import pytest

from auditlake.llm import bpe, token_counts

from . import frames

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "²", "日本", " ", " ", "\x1c", "\x85",
          "😀", "<|endoftext|>", "the", "ing", "__", "​", "́", "!!!", "\r\n", "٣"]


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs(bpe.vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))


def test_ids_and_texts_are_those_of_the_library(coder, library):
    random_ = random.Random(1)
    texts = ["".join(random_.choice(PIECES) for _ in range(random_.randint(0, 16))) for _ in range(2000)]
    texts += [t or "" for _, t in frames.AWKWARD]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_parts_of_characters_decode_to_the_replacement_character(coder, library):
    ids = library.encode("😀日", add_special_tokens=False).ids[:-1]
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(KeyError):
        coder.decode([999_999])


def test_the_pieces_of_a_large_vocabulary_are_merged_once(monkeypatch):
    """As many different pieces as a task may meet, with other signs behind them each time."""
    coder, merged = bpe.BytePairs(bpe.vocabulary("byte_bpe_50k.json")), []
    monkeypatch.setattr(coder, "merge", lambda piece: merged.append(piece) or [0])
    names = ["".join(chr(97 + k // 26**d % 26) for d in range(4)) for k in range(100_000)]
    for sign in ".!":
        coder.encode_pieces(" ".join(f"{name}{sign}" for name in names))
    assert len(merged) <= 100_000 + 3


def test_round_trip_of_awkward_rows(spark, library):
    path = bpe.vocabulary("byte_bpe_50k.json")
    found = bpe.round_trip(frames.documents(spark, frames.AWKWARD), path).collect()
    expected = []
    for doc_id, text in frames.AWKWARD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=frames.key) == sorted(expected, key=frames.key)
    assert bpe.round_trip(frames.documents(spark, []), path).count() == 0
    tokens = bpe.encoded(frames.documents(spark, frames.AWKWARD), path)
    back = bpe.decoded(tokens, path).collect()
    assert sorted(map(tuple, back), key=frames.key) == sorted(
        ((i, t or "") for i, t in frames.AWKWARD), key=frames.key
    )


def by_hand(parts, path):
    """Sections of characters, and tokens given out one at a time."""
    encoder, _ = token_counts.loaded(path)
    text = "\n".join(parts)
    owner, section = [], 0
    for n, part in enumerate(parts):
        for character in part + ("\n" if n < len(parts) - 1 else ""):
            owner.append(section)
            section += n == len(parts) - 1 and character == "\n"
        section += n < len(parts) - 1
    counts = [0] * (section + 1)
    raw, at = text.encode(), 0
    for token in encoder.encode_ordinary(text):
        size = len(encoder.decode_single_token_bytes(token))
        first = len(raw[: at + 1].decode(errors="ignore")) - (1 if raw[at] & 0xC0 != 0x80 and raw[at] < 0x80 else 0)
        characters = {
            len(raw[:k].decode(errors="ignore")) if raw[k] & 0xC0 != 0x80 else len(raw[:k].decode(errors="ignore"))
            for k in range(at, at + size)
        }
        assert first >= 0
        held = [owner[c] for c in characters]
        counts[min(set(held), key=lambda s: (-held.count(s), s))] += 1
        at += size
    return counts


def test_tokens_are_given_to_sections_by_the_rule(spark):
    path = bpe.vocabulary("byte_bpe_50k.tiktoken")
    random_ = random.Random(3)
    texts = ["".join(random_.choice([*PIECES, "\n\n", "\n \n"]) for _ in range(random_.randint(0, 20))) for _ in range(300)]
    rows = [(n, t) for n, t in enumerate(texts)] + frames.AWKWARD[:8] + frames.AWKWARD[-1:]
    documents = frames.documents(spark, rows).selectExpr("*", "concat('src', doc_id) AS source", "'' AS lang")
    found = token_counts.token_counts(documents, ("source", "lang", "text"), path).collect()
    counted = {}
    for row in found:
        counted.setdefault(row.doc_id, {})[row.section] = row.n_tokens
        assert row.field == ("source", "lang", "text")[min(row.section, 2)]
    for doc_id, text in rows[:300]:
        expected = by_hand([f"src{doc_id}", "", text], path)
        assert [counted[doc_id][k] for k in range(len(expected))] == expected, text
    assert sum(r.n_chars for r in found if r.doc_id == 910) == len("src910") + 2 + len(frames.AWKWARD[-1][1])
    assert token_counts.token_counts(documents.limit(0), ("text",), path).count() == 0
