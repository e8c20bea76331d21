"""Secret scan, quality rules, token counts and packing against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import common, packing, queries, secret_scan, token_counts
from tidemark.llm.line_frequency import line_quality

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans_of(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def row_key(row):
    return tuple((x is not None, x) for x in row)


def bag(rows):
    return sorted((tuple(r) for r in rows), key=row_key)


def test_secret_scan_equals_plain_matching(spark, docs, folder):
    got = queries.op10_secret_scan(spark, folder).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        found = spans_of(r.text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
        counts = Counter(k for _, _, k, _ in found)
        want.append((r.doc_id, *(counts[k] for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()))
    assert bag((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == bag(want)
    for r in got:
        base = [x for x in r.spans.split(",") if x and not x.startswith("owned")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert any("owned" in r.spans for r in got)


def test_widely_copied_secrets_are_examples(spark):
    own, shared = "Zx9QWw8Er7Ty6Ui5Op4Lk3", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    rows = [(i, f"see token={shared} now", f"owner{i % 7}") for i in range(30)] + [(99, f"my {own} and token: {shared}", "me")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(r.id, r.kind, r.live, r.owners) for r in secret_scan.secret_spans(df).collect()}
    assert (99, "owned", True, 1) in found and (99, "assign", False, 8) in found
    texts = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert texts[99] == f"my [SECRET] and token: {shared}" and texts[0] == rows[0][1] and len(texts) == 31


def test_keys_in_many_documents_of_one_source_are_examples(spark):
    example, own = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "Zx9QWw8Er7Ty6Ui5Op4Lk3"
    rows = [(i, f"text {i} has token={example}", "hot") for i in range(31)] + [(100 + i, f"my {own} here", "hot") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(r.kind, r.live, r.owners, r.repositories) for r in secret_scan.secret_spans(df).collect()}
    assert found == {("assign", False, 1, 31), ("hex", False, 1, 31), ("owned", True, 1, 1)}
    assert {r.repositories for r in secret_scan.secret_spans(df, repository_col="doc_id").where("kind = 'owned'").collect()} == set()
    texts = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert texts[0] == rows[0][1] and texts[100] == "my [SECRET] here"


def test_redaction_broadcasts_few_spans_only(spark, monkeypatch):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(10)]
    df = spark.createDataFrame([(1, " x ".join(keys), "me")], "doc_id long, text string, source string")
    for rows, hinted in ((5, False), (50, True)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        out = secret_scan.redact(df)
        assert ("ResolvedHint" in out._jdf.queryExecution().analyzed().toString()) == hinted
        assert out.first().text == " x ".join(["[SECRET]"] * 10)


def test_line_quality_counts(spark, docs):
    got = line_quality(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        want.append((r.doc_id, len(words), len("".join(words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert bag(tuple(r[n] for n in names) for r in got) == bag(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_boilerplate_lines_deplete_documents(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i, n: " ".join(f"w{i}x{j}".translate(letters) for j in range(n))
    notice = " ".join(f"notice{j}".translate(letters) for j in range(60))
    rows = [(i, f"{notice} {i}\n{own(i, 55)}", "big") for i in range(40)] + [(100 + i, f"{notice} {i}\n{own(i, 200)}", "big") for i in range(10)]
    rows += [(200, f"{notice} 3\n{own(1, 10)}", "small"), (300, own(7, 80), None)] + [(400 + i, own(9, 90), "big") for i in range(60)]
    got = {r.doc_id: (r.kept, r.n_line_words) for r in line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (False, 61) and got[100] == (True, 61)
    assert got[200] == (True, 0) and got[300] == (True, 0) and got[400] == (True, 0)


def test_copies_do_not_change_verdicts_on_lines(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i: " ".join(f"w{i}x{j}".translate(letters) for j in range(60))
    rows = [(i, ("menu of the site\n" if i < 30 else "") + own(i), "host") for i in range(100)]
    more = [(1000 + i, own(99), "host") for i in range(300)] + [(2000 + i, x, "host") for i in range(300) for x in (None, "", " \n")]
    verdicts = []
    for table in (rows, rows + more):
        df = spark.createDataFrame(table, "doc_id long, text string, source string")
        got = line_quality(df, max_share=0.2).where("doc_id < 100").collect()
        verdicts.append(sorted((r.doc_id, r.kept, r.n_line_words) for r in got))
    assert verdicts[0] == verdicts[1] and verdicts[1][0][2] == 4


def test_token_counts_equal_the_library(spark, docs, folder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = queries.op4_token_counts(spark, folder).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert bag(got) == bag(want)


def test_token_counts_without_a_head(spark, docs, folder, monkeypatch):
    want = bag(queries.op4_token_counts(spark, folder).collect())
    monkeypatch.setattr(token_counts, "HEAD", 3)
    assert bag(queries.op4_token_counts(spark, folder).collect()) == want


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == bag(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins), -(-sum(r.length for r in rows) // 2048)


def test_packing_is_exact_and_tight(spark, docs, folder):
    used, least = check_packing(queries.op9_best_two_fit(spark, folder).collect(), docs)
    assert used <= least + 1


def test_a_batch_is_tokenized_in_little_memory(monkeypatch):
    """Neither all words of a batch nor all its new words are held or encoded at once; before, both were."""
    import tracemalloc

    tokenizer = packing.WordTokenizer(queries.tokenizer_file("word_bpe_49k.json"))
    texts = [b"thread orbit " * 20_000, None] * 20
    tracemalloc.start()
    got = tokenizer.ids(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - sum(map(len, got)) < 10_000_000
    learned = []
    monkeypatch.setattr(packing.WordTokenizer, "PORTION", 3)
    monkeypatch.setattr(tokenizer, "_learn", lambda words, learn=tokenizer._learn: (learned.append(len(words)), learn(words)))
    odd = [b"Seven new-words, x1 na\xc3\xafve seven SEVEN x2", b"", b"x2 x3"]
    want = [tokenizer.library.encode(x.decode(), add_special_tokens=False).ids for x in odd]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.ids(odd)] == want
    assert sum(learned) == 8 and max(learned) == 3


def test_words_are_looked_up_once_a_batch():
    """Copies in a batch cost no further search among the known words; before, every word of every text did."""
    path = queries.tokenizer_file("word_bpe_49k.json")

    class Known(dict):
        asked = 0

        def get(self, *args):
            Known.asked += 1
            return super().get(*args)

        def __getitem__(self, word):
            Known.asked += 1
            return super().__getitem__(word)

    tokenizer = packing.WordTokenizer(path)
    texts = [b"Thread orbit, LATTICE copper-ware don't na\xc3\xafve x9 thread", None, b""] * 50
    want = [tokenizer.library.encode((x or b"").decode(), add_special_tokens=False).ids for x in texts]
    tokenizer.ids(texts[:3])
    tokenizer.known = Known(tokenizer.known)
    got = [np.frombuffer(x, "<u4").tolist() for x in tokenizer.ids(texts)]
    assert got == want and Known.asked <= 8
    assert tokenizer.alone


def test_two_documents_replace_the_shortest():
    # Greedy takes 6 and 3; a gap of 1 stays. 2 + 2 fill it exactly in place of 3.
    plan = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    first = sorted((length, per_bin) for length, _, _, per_bin, b, _ in plan if b == 0)
    assert first == [(2, 2), (6, 1)]


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op4_token_counts", "op7_line_quality", "op9_best_two_fit", "op10_secret_scan"])
def test_empty_table(spark, empty, tmp_path, name):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
