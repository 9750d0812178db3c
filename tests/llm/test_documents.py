"""Operators on documents against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirelens.llm import chunks, language, lines, packing, quality, registry, secrets, sentences, simhash

SF = "/root/testdata/sf0.01"
TYPES = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["doc", "version", "pos", "row", "gone", "lines", "kept", "blob", "spans", "fp", "h1", "range", "place"]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, TYPES)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(-1))
    return df


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sample):
    return {r.doc_id: r.text for r in sample.select("doc_id", "text").collect()}


# --- line dedup ---------------------------------------------------------------------------


def brute_lines(rows):
    """rows: (id, text); null ids count as the largest."""
    big = 2**63 - 1
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, big), big if i is None else i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if len(key(x)) < 10 or owner[key(x)] == (big if i is None else i)]
        out.append((i, len(all_lines), len(all_lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def ours_lines(docs, **how):
    kept = lines.kept_lines(docs, lines.lost_lines(docs, **how))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in kept.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


ODD_LINES = [
    "a shared line here\nown", "A SHARED LINE HERE \nÄÖÜ other text\n", None, "", "\n\n", "\t a shared line here",
    "short\nshort", "ÄÖÜ other text\na shared line here\na shared line here", "x" * 5000 + "\n" + "shared tail line",
    "shared tail line\nshared tail line", "äöü other text",
]


@pytest.mark.parametrize("how", [{}, {"batches": 1}, {"batches": 7, "fanout": 2}])
def test_line_dedup_odd_rows(spark, how):
    ids = [*range(len(ODD_LINES)), 3, 3, None, None]
    all_texts = [*ODD_LINES, "a shared line here", "a shared line here", "shared tail line", None]
    docs = frame(spark, all_texts, ids)
    assert ours_lines(docs, **how) == brute_lines(list(zip(ids, all_texts)))


def test_line_dedup_whole(sample, texts):
    assert ours_lines(sample) == brute_lines(list(texts.items()))


def test_line_dedup_empty(spark):
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_line_runs_take_batches_one_by_one(spark, tmp_path):
    runs = lines.LineRuns(spark, f"file://{tmp_path}", fanout=2, buckets=2)
    lost = []
    for number in range(5):
        docs = frame(spark, ["the same old line", f"new line of {number}"], [2 * number, 2 * number + 1])
        lost.append(runs.add(lines.line_keys(docs)).count())
        runs.compact()
    assert lost == [0, 1, 1, 1, 1]
    assert [len(runs.levels[k]) for k in range(3)] == [1, 0, 1]
    assert sum(spark.table(r).count() for r in runs.runs) == 6
    assert "Exchange hashpartitioning(h1" not in spark.table(runs.runs[0]).groupBy("h1", "h2").count()._jdf.queryExecution().executedPlan().toString()
    runs.close()


# --- SimHash ------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    from xxhash import xxh64_intdigest

    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    hashes = [xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(fps, max_bits=2):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_whole(spark, sample, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups = brute_groups(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in registry.op8_simhash(spark, SF).collect()}
    assert got == {i: (fps[i], groups[i]) for i in fps}
    assert len(set(groups.values())) < len(groups)


def test_simhash_groups_of_frequent_and_rare_fingerprints(spark):
    """Some fingerprints are above, some below the share that is sent to all tasks."""
    rng = np.random.default_rng(8)
    rare = [" ".join(f"w{n}" for n in rng.integers(0, 10**6, 12)) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate(rare + rare[:40] + ["the same text in many rows"] * 1500 + [None] * 50)]
    rng.shuffle(rows)
    counts = Counter(simhash.fingerprint(t or "") for _, t in rows)
    assert min(counts.values()) * simhash.HOT_SHARE <= len(rows) < max(counts.values()) * simhash.HOT_SHARE
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    smallest = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        smallest.setdefault(simhash.fingerprint(t or ""), i)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert got == {i: smallest[simhash.fingerprint(t or "")] for i, t in rows}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(smallest.values())


def test_simhash_odd_rows(spark):
    odd = [None, "", " \x0b ", "One", "one", "two words", "É é É x", "a b c d " * 3000, "A B C D " * 3000, "x\x1cy\xa0z w"]
    docs = frame(spark, [*odd, "one"], [*range(10, 10 + len(odd)), None])
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs).collect()}
    fps = {i + 10: brute_fingerprint(t) for i, t in enumerate(odd)}
    groups = brute_groups(fps)
    assert {i: got[i] for i in fps} == {i: (fps[i], groups[i]) for i in fps}
    assert got[None][1] == 13
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))
    assert kept.columns == docs.columns
    assert simhash.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_near_links_of_dense_fingerprints(spark, max_bits):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fps = set()
    for c in map(int, centres):  # dense balls, most pairs within a few bits
        for _ in range(150):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            fps.add(c ^ sum(1 << int(b) for b in flips))
    fps |= {0, 2**64 - 1, 2**63, 2**64 - 2}
    signed = [f - (1 << 64 if f >> 63 else 0) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= max_bits for a, b in links)
    want = brute_groups(dict.fromkeys(sorted(signed)) | {f: f & (2**64 - 1) for f in signed}, max_bits)
    root = {f: f for f in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {f: find(f) for f in signed} == want
    assert len(links) < 70 * len(fps)


# --- secrets ------------------------------------------------------------------------------


def brute_spans(text):
    found = []
    for m in re.finditer(r"(?i:(?a:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_secrets_whole(spark, texts):
    got = {r.doc_id: r for r in registry.op9_secrets(spark, SF).collect()}
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 10
    for i, t in texts.items():
        spans = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].spans == text and got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [
            sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")
        ]


ODD_SECRETS = [
    None, "", "password: token = abcdefghijkl", "Token='abc+/_.=-123456", "API_KEY = short", "toſen: aaaaaaaaaaaaa",
    "é AKIA" + "A" * 14 + " AKIA123", "0123456789abcdef0", "0123456789ABCDEF", "secret:" + "f" * 20, "x " * 40000 + "passwd=abcdefghijklm",
]


def test_secrets_odd_rows(spark):
    docs = frame(spark, [*ODD_SECRETS, ODD_SECRETS[2], ODD_SECRETS[9]], [*range(len(ODD_SECRETS)), 2, None])
    got = sorted(((r.doc_id, r.spans) for r in secrets.scan_documents(docs).collect()), key=str)
    want = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or ""))) for i, t in enumerate(ODD_SECRETS)]
    assert got == sorted([*want, want[2], (None, want[9][1])], key=str)
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[0].text is None and clean[9].text == "[secret]" and clean[9].n_chars == 8
    assert clean[10].text.endswith("x [secret]") and clean[4].text == ODD_SECRETS[4]
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.scan_documents(frame(spark, [])).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = frame(spark, ["token=abcdefghijklmn", "plain", "plain"])
    assert secrets.scan_new(first, ledger).count() == 2
    assert secrets.scan_new(frame(spark, ["plain", "more"], [7, 8]), ledger).count() == 3
    assert spark.read.schema(secrets.LEDGER).parquet(ledger).count() == 3
    other = (("hex", "[0-9a-f]{4,}", 0, 0, 4),)
    assert secrets.scan_new(first, ledger, other).count() == 2  # another rule version
    assert spark.read.schema(secrets.LEDGER).parquet(ledger).count() == 5


def test_repeated_ledger_rows_do_no_harm(spark, tmp_path):
    """A job that appended its findings twice; also the findings in versions that were replaced."""
    ledger = f"file://{tmp_path}/ledger"
    key = "token = abcdefghijklmnop"
    docs = frame(spark, [key, "plain", key], [1, 2, 3])
    once = sorted(map(tuple, secrets.scan_documents(docs, ledger).collect()))
    spark.read.parquet(ledger).write.mode("append").parquet(ledger)
    assert sorted(map(tuple, secrets.scan_documents(docs, ledger).collect())) == once and len(once) == 3
    assert [r.text for r in secrets.redact(docs, ledger).orderBy("doc_id").collect()] == ["[secret]", "plain", "[secret]"]
    later = frame(spark, ["nothing now", "plain", None], [1, 2, None])
    assert {r.spans for r in secrets.scan_documents(later, ledger).collect()} == {""}
    seen = secrets.history(spark, ledger).collect()
    assert sorted((r.doc_id, r.spans) for r in seen if r.spans) == [("1", once[0][1]), ("3", once[0][1])]
    assert len(seen) == 5


# --- packing ------------------------------------------------------------------------------


def check_packed(rows, ids_of, room=1024):
    """Every id in one piece, offsets without gaps; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= room
        padding += 0 if at & (at - 1) == 0 else room - at
    return padding / sum(r.length for r in rows)


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.vocabulary("byte_bpe_50k.json"))
    return [x.ids + [0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_whole(spark, texts):
    rows = registry.op3_packing(spark, SF).collect()
    assert check_packed(rows, dict(zip(texts, plain_ids(texts.values())))) < 0.02


ODD_SPACES = [
    None, "", " ", "  ", "   ", "a  b", "a   b", " a\n b \n", "a \n\n  b", "a\t b", "\x85 x", "a \x1c b", "x  ", "x ", "<|endoftext|> y", "a<|endoftext|> b", "a <|endoftext|><|endoftext|>", "<|endoftext|", "  <|endoftext|>  <|endoftext|> \n <|endoftext|>",
    "don't  stop", "\u00a0 a", "e\u0301 ñ 漢字 🙂", "a" * 30000, "w " * 9000, "\n \n", "1 2  3",
]


def test_word_table_gives_the_tokenizer_s_ids():
    encode = packing.WordIds(registry.vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    mixed = ["".join(rng.choice(list(" \n\tab1.é'"), 12)) for _ in range(3000)]
    cases = [t or "" for t in ODD_SPACES] + mixed
    got = [np.frombuffer(b, "<u4").tolist() + [0] for b in map(encode, cases)]
    assert got == plain_ids(cases)


def test_packing_odd_rows(spark):
    docs = frame(spark, ODD_SPACES)
    rows = packing.pack(docs, registry.vocabulary("byte_bpe_50k.json"), group_tokens=4096).collect()
    check_packed(rows, dict(enumerate(plain_ids(ODD_SPACES))))
    again = packing.pack(frame(spark, ["x y", "x y"], [1, 1]), registry.vocabulary("byte_bpe_50k.json"))
    assert again.count() == 2
    assert packing.pack(frame(spark, []), registry.vocabulary("byte_bpe_50k.json")).count() == 0


def test_assign_takes_the_cheapest_sequence_with_room():
    lengths = sorted(np.random.default_rng(3).integers(1, 65, 300).tolist(), reverse=True)
    n = -(-sum(lengths) // 64)
    used, cost, taken = [0] * n, [0.0] * n, [0] * len(lengths)
    for i, at, size, k, offset in packing.assign(lengths, 64, 1.0, 0.1):
        rest = lengths[i] - taken[i]
        fit = [j for j in range(n) if used[j] + rest <= 64] or [j for j in range(n) if used[j] < 64]
        assert at == taken[i] and offset == used[k] and size == min(rest, 64 - used[k])
        assert k in fit and cost[k] == min(cost[j] for j in fit)
        used[k] += size
        cost[k] += size + 0.1 * size * size
        taken[i] += size
    assert taken == lengths and sum(64 - u for u in used) < 64


# --- chunk fingerprints -------------------------------------------------------------------


def brute_cuts(data):
    ends, start = [], 0
    h = [sum(int(chunks.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) & 0xFFFF for i in range(len(data))]
    for i in range(len(data)):
        n = i + 1 - start
        if i + 1 < len(data) and n >= 16 and (h[i] < (1 << 9 if n < 48 else 1 << 11) or n == 255):
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(data)] if data else [])


def test_cut_points(texts):
    for t in [*list(texts.values())[:60], "", "a", "a" * 3000]:
        assert chunks.cut_points(t.encode()) == brute_cuts(t.encode())


def test_cut_points_over_blocks(monkeypatch, texts):
    data = max(texts.values(), key=len).encode()
    whole = chunks.cut_points(data)
    monkeypatch.setattr(chunks, "BLOCK", 777)
    assert chunks.cut_points(data) == whole


def brute_edited(rows):
    """rows in order: (id, text)."""
    out = []
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        sets = [chunks.chunk_set(x) for x in (t, edited, following)]
        share = lambda a, b: float(not b) if not a else sum(v for d, v in a.items() if d in b) / sum(a.values())
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), chunks.fingerprint(sets[0]), chunks.fingerprint(sets[1]), share(sets[0], sets[1]), share(sets[0], sets[2])))
    return sorted(out, key=str)


def test_edited_likeness_whole(spark, texts):
    got = sorted((tuple(r) for r in registry.op2_chunk_fingerprints(spark, SF).collect()), key=str)
    assert got == brute_edited(sorted(texts.items()))
    near = np.mean([r[5] for r in got if r[1] > 500])
    assert 0.4 < near < 0.6 and np.mean([r[6] for r in got]) < 0.1


def test_edited_likeness_odd_rows(spark):
    rows = [(1, ""), (2, "short"), (2, "short"), (2, "z other"), (5, "ä€🙂" * 400), (5, "ä€🙂" * 400), (9, "x" * 70000)]
    docs = frame(spark, [*(t for _, t in rows), None], [*(i for i, _ in rows), None])
    got = sorted((tuple(r) for r in chunks.edited_likeness(docs).collect()), key=str)
    assert got == brute_edited([*rows, (None, "")])
    one = chunks.edited_likeness(frame(spark, ["alone here"])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(0, 1.0)]
    assert chunks.edited_likeness(frame(spark, [])).count() == 0
    prints = {r.doc_id: r.fingerprint for r in chunks.fingerprints(docs).collect()}
    assert prints[1] == prints[None] == "" and prints[9] == chunks.fingerprint(chunks.chunk_set("x" * 70000))


# --- SentencePiece ------------------------------------------------------------------------

MODEL = registry.vocabulary("piece_bpe_32k.model")


def brute_path(solver, s):
    """Highest sum of piece scores over all segmentations, by exhaustive recursion from the right."""
    best = {len(s): 0.0}
    for i in range(len(s) - 1, -1, -1):
        options = [solver.score[s[i:j]] + best[j] for j in range(i + 1, min(len(s), i + solver.longest) + 1) if s[i:j] in solver.score]
        if s[i] not in solver.score:
            options.append(solver.fallback + best[i + 1])
        best[i] = max(options)
    return best[0]


def score_of(solver, ids):
    known = {v: k for k, v in solver.id.items()}
    return sum(solver.score[known[i]] for i in ids if i in known)


ODD_PIECES = [
    None, "", " ", "  a   b  ", "tab\tnew\n\nline", "▁mark ▁▁", "漢字 🙂 \u0301", "a" * 700, "ab " * 900 + "x" * 150,
    "<s> </s> <0x41> <unk>", "no blanks " + "thonanthe" * 60, "   " * 200, "é" * 300 + " " + "🙂" * 90,
]


@pytest.mark.parametrize("chunk", [1 << 14, 64, 17])
def test_sentences_round_trip_and_optimum(spark, texts, chunk):
    solver = sentences.pieces(MODEL)
    every = [*ODD_PIECES, *list(texts.values())[:40]]
    docs = frame(spark, [*every, every[8]], [*range(len(every)), 8])
    found = sentences.decode(sentences.encode(docs, MODEL, chunk=chunk), MODEL).collect()
    assert sorted(r.doc_id for r in found) == sorted([*range(len(every)), 8])
    for r in found:
        text = every[r.doc_id] or ""
        assert r.text == text
        assert r.n_chunks == (1 if len(text) < chunk else -(-(len(text) + 1) // chunk))
        assert r.score == brute_path(solver, " " + text)
        unknown = sum(c not in solver.score for c in " " + text)
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert score_of(solver, ids) + unknown * solver.fallback == pytest.approx(r.score, rel=1e-12)


def test_new_words_solved_together_are_best_paths(texts):
    rng = np.random.default_rng(5)
    solver = sentences.Pieces(MODEL)
    letters = [p for p in solver.score if len(p) == 1]
    words = {w for t in texts.values() for w in t.split(" ")}
    words |= {"".join(rng.choice(letters, rng.integers(1, 300))).replace(" ", "") for _ in range(300)}
    words |= {"".join(rng.choice([*"theainrs"], rng.integers(1, 300))) for _ in range(300)}
    solver.known.learn([*words])
    assert len(solver.known) > len(words) / 2
    for word, ids in solver.known.items():
        assert ids == solver.between(" " + word, 0, len(word) + 1)


def test_spans_of_new_words_are_best_paths_without_a_table():
    """Many words that occur once: each is solved with its neighbours, and none is kept."""
    rng = np.random.default_rng(6)
    solver = sentences.Pieces(MODEL)
    for letters in ("theainrs", "theainrsßÄ.é"):
        words = ["".join(rng.choice([*letters], rng.integers(6, 14))) for _ in range(3000)]
        text = "".join(" " + w for w in words)
        assert solver.words(text) == solver.between(text, 0, len(text))
    assert len(solver.known) < 300


def test_spans_with_doubtful_blanks_runs_and_breaks_are_best_paths():
    rng = np.random.default_rng(7)
    solver = sentences.Pieces(MODEL)
    long = solver.known.quick[1]
    parts = [" ", " ", "  ", " " * (long + 3), "\n", "\t", "▁", "漢", "🙂", "ê", "êt", "ERN", "ít", "ß", "the", "ing", "x" * (long - 1), "é" * (long + 9)]
    odd = ["", " ", " \n", " \n ", " a\n\nb ", " ê", " " + "x" * long + " a", " a\nê ERN"]
    for text in [*odd, *(" " + "".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(150))]:
        assert solver.words(text) == solver.between(text, 0, len(text)), text


def test_sentences_whole_round_trip(spark, texts):
    got = {r.doc_id: r.decoded_sha256 for r in registry.op4_sentencepiece(spark, SF).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_sentences_no_rows(spark):
    assert sentences.encode(frame(spark, []), MODEL).count() == 0


def chunk_matrices(solver, s, chunk):
    out = []
    for p in range(0, len(s), chunk):
        part = s[p : p + chunk + solver.longest - 1]
        out.append(solver.matrix(part, min(chunk, len(s) - p), p + chunk >= len(s))[:2])
    return out


def test_max_plus_products_are_associative(texts):
    """Scores and ranks, of matrices of texts with many ties."""
    solver = sentences.pieces(MODEL)
    s = " " + "aaaaaaa bb  bbbbbbb ccccccccccccccccccccccccc" * 9
    for chunk in (17, 30):
        a, b, c, *_ = chunk_matrices(solver, s, chunk)
        left, right = sentences.times(sentences.times(a, b), c), sentences.times(a, sentences.times(b, c))
        assert (left[0] == right[0]).all() and (left[1] == right[1]).all()


def test_ids_do_not_depend_on_chunks(spark, texts):
    every = [*ODD_PIECES, *list(texts.values())[:30], "ab" * 3000, "aaaaaaaa " * 200, "\n".join(["=" * 70] * 40)]
    whole = {r.doc_id: bytes(r.ids) for r in sentences.encode(frame(spark, every), MODEL).collect()}
    for chunk in (17, 64, 999):
        found = sentences.encode(frame(spark, every), MODEL, chunk=chunk).collect()
        assert {r.doc_id: bytes(r.ids) for r in found} == whole


def test_round_trip_is_encode_then_decode(spark, texts):
    docs = frame(spark, [*ODD_PIECES, *list(texts.values())[:10]])
    for chunk in (40, sentences.CHUNK):
        trip = {r.doc_id: r for r in sentences.round_trip(docs, MODEL, chunk=chunk).collect()}
        for r in sentences.decode(sentences.encode(docs, MODEL, chunk=chunk), MODEL).collect():
            t = trip[r.doc_id]
            assert (t.n_tokens, t.ids_crc32, t.score, t.n_chunks) == (len(r.ids) // 4, zlib.crc32(r.ids), r.score, r.n_chunks)
            assert t.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert sentences.round_trip(frame(spark, []), MODEL).count() == 0


# --- quality and language -----------------------------------------------------------------


def test_letters_are_the_unicode_categories_of_letters(spark, sample):
    import unicodedata

    texts = ["½ ²", "Ⅷ ①", "_ 12", "ª", "ж", "ー", "", None, "٣", "\u0300", "a"]
    model = language.train(sample.limit(200))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        letter = any(unicodedata.category(c)[0] == "L" for c in t or "")
        assert (got[i][0] != "und") == letter and (letter or got[i][1] == 0)
    assert language.predict(frame(spark, []), model).count() == 0


def test_language_against_its_formula(spark, sample):
    """Predictions in batches are those of the kernel written out for one text at a time."""
    model = language.train(sample, per_language=20, landmarks=12)
    rows = sample.orderBy("doc_id").limit(60).select("doc_id", "text")
    for r in language.predict(rows, model).collect():
        data = (r.text or "").lower().encode()
        held = {tuple(data[i : i + n]) for n in (1, 2, 3) for i in range(len(data) - n + 1)}
        buckets = {(sum(c << 8 * i for i, c in enumerate(g)) + (len(g) << 28)) * 2654435761 % 2**32 >> language.SHIFT for g in held}
        row = np.zeros(language.BUCKETS)
        row[list(buckets)] = 1
        values = (row @ model.landmarks.T / max(np.sqrt(row.sum()), 1)) @ model.weights
        if r.lang_pred != "und":
            assert model.languages[int(values.argmax())] == r.lang_pred
            assert r.score == pytest.approx(min(1, max(0, (values.max() + 1) / 2)), abs=1e-4)


def test_training_takes_the_smallest_places_of_each_language(spark):
    """More texts of one language than wanted: all of them at the smallest hashes, whatever their order."""
    rows = [(f"text {i}", "a" if i % 10 else "b") for i in range(3000)] + [("text 1", "a"), (None, "a"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    one, other = (language.train(d, per_language=50, landmarks=10) for d in (df, df.orderBy(F.rand(3))))
    assert one.languages == ("a", "b") and (one.weights == other.weights).all()



def test_quality_against_held_labels(spark, sample):
    """The labels are never seen in training."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = registry.op5_quality(spark, SF).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    assert np.mean([(r.posterior > 0.5) == (r.quality == 1) for r in rows]) > 0.97


def test_expectation_maximisation_finds_accuracies(monkeypatch):
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    right = rng.random((20000, 5)) < accuracy
    cast = np.where(rng.random((20000, 5)) < 0.2, quality.NOTHING, np.where(right == truth[:, None], quality.GOOD, quality.BAD))
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    monkeypatch.setattr(quality, "SHARE", 0.0)  # the labellers of this test are not of the prior's kind
    good, chances = quality.estimate(patterns, counts.astype(float))
    assert good == pytest.approx(0.8, abs=0.02)
    found = chances[1, :, quality.GOOD] / (chances[1, :, quality.GOOD] + chances[1, :, quality.BAD])
    assert np.abs(found - accuracy).max() < 0.03


def test_quality_odd_rows(spark, sample):
    model = quality.train(sample)
    docs = frame(spark, [None, "", "word " * 30000, "One plain sentence of words.", "A!! B!!"], [1, 2, 3, None, 3])
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id == 1} == {r.score for r in rows if r.doc_id == 2}
    assert quality.keep_good(docs, model).columns == docs.columns
    nothing = quality.train(frame(spark, []))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.5}


def test_quality_of_repeated_and_null_texts(spark, monkeypatch):
    """The scorer learns from all distinct texts, however often they are repeated."""
    nothing = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = quality.scored(nothing, quality.train(nothing)).select("posterior", "score").distinct().collect()
    assert len(rows) == 1 and 0 <= rows[0].score < 0.5
    drawn = []
    fit = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda x, y: drawn.append(len(x)) or fit(x, y))
    words = F.concat(F.lit("Some words about number "), (F.col("id") % 50).cast("string"), F.lit("."))
    quality.train(spark.range(50_000).select(words.alias("text")))
    quality.train(spark.range(50_000).select(F.when(F.col("id") % 3 == 0, words).alias("text")))
    assert drawn == [50, 51]


def test_language_held_out(spark, sample):
    truth = {r.doc_id: r.lang for r in sample.collect()}
    rows = registry.op7_language(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean(held) > 0.97


def test_language_odd_rows(spark, sample):
    model = language.train(sample.select("text", "lang"))
    docs = frame(spark, [None, "", "123 --", "é", "the " * 40000], [1, 2, 3, 4, None]).withColumn("score", F.lit("x"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in model.languages and got[None][0] == "en" and 0 <= got[None][1] <= 1
    nothing = language.train(frame(spark, []).select("text", "lang"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_kernel_counts_shared_grams():
    a, b = language.grams("abab"), language.grams("ABx")
    assert (a & b).sum() == len({"a", "b", "ab"})
    k = language.kernel(np.stack([a]).astype(float), np.stack([b / np.sqrt(b.sum())]))
    assert k[0, 0] == pytest.approx(3 / np.sqrt(a.sum() * b.sum()))


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, sample, texts):
    """Each stage on what the one before kept."""
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_classifier(spark, sample, SF).collect()}
    model = quality.train(sample)
    score = lambda t: 1 / (1 + np.exp(-np.clip(quality.features(t) @ model.weights, -500, 500)))
    assert set(kept) == {i for i, t in texts.items() if score(t) >= 0.5}
    kept = {i: t for i, _, _, t in brute_lines(sorted(kept.items()))}
    groups = brute_groups({i: brute_fingerprint(t) for i, t in sorted(kept.items())})
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    for i, t in kept.items():
        found, done, out = brute_spans(t), 0, ""
        for _, a, b in found:
            if a >= done:
                out += t[done:a] + "[secret]"
            done = max(done, b)
        kept[i] = out + t[done:]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    check_packed(rows, dict(zip(kept, plain_ids(kept.values()))))


def test_pipeline_keeps_columns(spark, sample):
    docs = sample.limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == sample.columns, name
