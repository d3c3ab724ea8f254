"""Subword encoding against the library, phrase mining and turn repair against brute force, and the odd cases of all three."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
import sentencepiece
from public_tokenizers import path
from sentencepiece import sentencepiece_model_pb2 as proto

from veilwork.llm import phrases, queries, subwords, turns

MODEL = path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string"


def variant(rule=None, fallback=True, **norm):
    """The public model with another normaliser, as bytes; nothing is trained."""
    with open(MODEL, "rb") as file:
        model = proto.ModelProto.FromString(file.read())
    if rule:
        made = proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    for name, value in norm.items():
        setattr(model.normalizer_spec, name, value)
    if not fallback:
        model.trainer_spec.byte_fallback = False
        for piece in model.pieces:
            if piece.type == 6:
                piece.type, piece.piece = 1, "\x01" + piece.piece
    return model.SerializeToString()


def odd_texts(n=600):
    r = random.Random(1)
    signs = "ab eéÉ ﬁ①Ａｱﾞ가\t\n　▁ ½™ x̂ 😀漢 the  ."
    made = ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(n)]
    return [*made, "", " ", "  a ", "▁", "a▁ ▁", "\n", "a" * 5000, " " * 300 + "x", "😀" * 50, "The quick brown fox. " * 20]


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"rule": "nmt_nfkc"},
        {"rule": "nmt_nfkc", "remove_extra_whitespaces": True},
        {"rule": "nfkc_cf", "remove_extra_whitespaces": True, "add_dummy_prefix": False},
        {"rule": "nfkc", "fallback": False},
        {"escape_whitespaces": False},
    ],
)
def test_pieces_and_spans_equal_the_library(options):
    model = variant(**options)
    encoder, library = subwords.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in odd_texts():
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert [*zip(*[a.tolist() for a in encoder.encode(text.encode())])] == want, text


def test_long_texts_are_cut_between_words(monkeypatch):
    encoder, library = subwords.Encoder(variant()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = " ".join(odd_texts(300))
    for chunk in (1, 7, 100):
        monkeypatch.setattr(subwords, "CHUNK", chunk)
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert [*zip(*[a.tolist() for a in encoder.encode(text.encode())])] == want


def test_bad_bytes_and_refused_models():
    encoder = subwords.Encoder(variant())
    ids, begins, ends = encoder.encode(b"a\xff\xfe b")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    mark = library.encode("a�")[1:]
    assert ids.tolist()[1:-1] == mark * 2 and begins.tolist()[-1] == 3 and ends.tolist()[-1] == 5
    model = proto.ModelProto.FromString(variant())
    model.pieces[300].type = 4
    with pytest.raises(ValueError):
        subwords.Encoder(model.SerializeToString())


def test_subwords_of_a_table(spark):
    rows = [(i, t, "en") for i, t in enumerate(odd_texts(50))] + [(None, None, None), (7, "again", None), (7, "again", None), (8, "word " * 400_000, "en"), (9, "x" * 300_000, "en")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS ids", "2 AS begins", "3 AS decoded")
    made = subwords.encode(df, MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["begins"][-1], len(r["ends"])) for r in made.collect())
    want = collections.Counter()
    for key, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        want[key, tuple(ids), library.decode(ids), len((text or "").encode()), len(ids)] += 1
    assert got == want
    assert subwords.encode(df.limit(0), MODEL).count() == 0


def test_op11_over_the_table(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {}
    for key, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_eos=True)
        want[key] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_subwords(spark, folder).collect()}
    assert got == want


# ---- phrases ------------------------------------------------------------------------------------------------------


def mined(rows, top=2000):
    """Every phrase by a dictionary, every cut and every longer candidate looked at."""
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            w = re.findall("[^ \t]+", piece)
            for n in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= 10}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "Of", "a", "été", "x", "y", "z", ".", "b,"]) for _ in range(r.randrange(60))), r.choice(["en", "fr", None, "und"])) for i in range(120)]
    return [*rows, (None, None, None), (1, "", "en"), (2, " \t\n ", "de"), (3, "solid state drive, " * 12 + "solid state", "en"), (3, "a\tb\x0bc\rd" * 20, "en"), (3, "the the the " * 30, "fr")]


def test_phrases_against_brute_force(spark, spoken):
    df = spark.createDataFrame(spoken, DOCS).selectExpr("*", "1 AS prefix", "2 AS segment", "3 AS f", "4 AS phrase")
    want = mined(spoken)
    assert len(want) > 50
    assert sorted(map(tuple, phrases.mine_phrases(df).collect())) == want
    # stripes passed on after a few words, and every row three times
    assert sorted(map(tuple, phrases.mine_phrases(df, at_once=50).collect())) == want
    assert sorted(map(tuple, phrases.mine_phrases(df.union(df).union(df), top=5).collect())) == mined(spoken * 3, 5)
    assert phrases.mine_phrases(df.limit(0)).count() == 0


def test_phrase_scores_are_exact(spark):
    big = 9_999_999_999_999_999
    row = spark.createDataFrame([(big, big, big - 1)], "a long, l long, r long").select(phrases._score(*[phrases.F.col(c) for c in "alr"]).alias("s")).first()
    assert row["s"] == 1000000 * big * big // (big * (big - 1))


def test_phrases_equal_their_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, queries.op12_phrases(spark, folder).collect())) == sorted(con.sql(phrases.ORACLE).fetchall())


# ---- turns --------------------------------------------------------------------------------------------------------


def cheapest(codes, inserts=3):
    """(cost, audit) by trying all edit strings."""
    found, grammar = [], re.compile(r"(s?(ua)+)?")

    def go(i, audit, roles, cost, more):
        if cost > 2 * len(codes):  # deleting all rows costs no more
            return
        if i == len(codes):
            if grammar.fullmatch(roles):
                found.append((cost, audit))
        else:
            code = codes[i]
            go(i + 1, audit + "D", roles, cost + 2, more)
            if code != "D":
                stay = 5 if code.isupper() else 0
                go(i + 1, audit + "K", roles + code.lower(), cost + stay, more)
                for role in "ua":
                    go(i + 1, audit + "R", roles + role, cost + 1 + stay, more)
        if more:
            for role in "ua":
                go(i, audit + "I", roles + role, cost + 5, more - 1)

    go(0, "", "", 0, inserts)
    return min(found)


def test_alignment_against_all_edit_strings():
    r = random.Random(3)
    for n in range(7):
        for _ in range(60):
            codes = "".join(r.choice("suaxSUAXDuaua") for _ in range(n))
            assert turns.align(codes) == cheapest(codes), codes


def test_alignment_of_long_conversations():
    r = random.Random(5)
    codes = "".join(r.choice("uasxUD") if r.random() < 0.2 else "ua"[i % 2] for i in range(3000))
    cost, audit = turns.align(codes)
    # the least cost by states: what follows is any string, the start, or what the last initial asks for
    best = {"": 0}
    for code in codes:
        def insert(now):
            for _ in range(3):
                for state, role in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    if state in now:
                        now[role] = min(now.get(role, 1 << 30), now[state] + 5)
            return now

        best, new = insert(best), {}
        for state, c in best.items():
            new[state] = min(new.get(state, 1 << 30), c + 2)
            if code != "D":
                stay = 5 if code.isupper() else 0
                role = "a" if state == "u" else "u"
                new[role] = min(new.get(role, 1 << 30), c + stay + (code.lower() != role))
                if state == "" and code in "sS":
                    new["s"] = min(new.get("s", 1 << 30), c + stay)
        best = new
    best = insert(best)
    assert cost == min(best[""], best["a"])
    assert sum(e != "I" for e in audit) == len(codes)


def repaired(rows):
    """Every conversation by the rules, one after the other."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        by[conv] += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for conv, some in by.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults, codes = set(), [], ""
        for _, role, text in some:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] and role[:1] in "sua" else "x"
            codes += "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = cheapest(codes) if len(codes) < 6 else turns.align(codes)
        numbers = [t for t, _, _ in some if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        lines, left, source = [], sum(e != "D" for e in audit), iter(some)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(source)
            if edit != "D":
                lines.append((role if edit == "K" else "user" if left % 2 == 0 else "assistant") + ":" + text)
                left -= 1
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def test_turn_repair_against_brute_force(spark):
    r = random.Random(6)
    words = ["Yes.", "no", "Why?", " ", "", None, "Fine! \n", "\\x", "long " * 50_000 + "."]
    rows = [(c, t if r.random() < 0.9 else r.choice([None, t + 3, t - 1]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(words)) for c in range(150) for t in range(r.randrange(7))]
    rows += [(None, 1, "user", "Hm."), (None, None, "assistant", "Ah."), (None, None, "assistant", "Ah."), (900, None, None, None)]
    rows += [(901, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS audit", "2 AS gone", "3 AS part", "'k' AS key")
    damaged = turns.damaged(df)
    made = turns.repair_digests(damaged).collect()
    assert made[0].asDict().keys() == {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"}
    assert {r["conv_id"]: tuple(r)[1:] for r in made} == repaired(rows) and len(made) == len({r[0] for r in rows})
    # the rows of the repaired conversations give the digests
    lines = collections.defaultdict(dict)
    for row in turns.repair(damaged, turns.audits(turns.faults(damaged))).collect():
        lines[row["conv_id"]][row["place"]] = f"{row['role']}:{row['text']}"
    for row in made:
        text = "\n".join(t for _, t in sorted(lines[row["conv_id"]].items()))
        assert hashlib.sha256(text.encode()).hexdigest() == row["repaired_sha256"]
    assert turns.repair_digests(turns.damaged(df.limit(0))).count() == 0


def test_op13_over_the_table(spark, folder):
    rows = list(map(tuple, spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, folder).collect()} == repaired(rows)
