"""Secret scans against plain searches, and the ledger."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weaklabel.llm.secret_scan import BASE, EXTRA, Kind, RuleSet, digest, findings, spans_of, update_ledger

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
SCHEMA = "doc_id long, text string"


def plain(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "api_key", "APIKEY", "ſecret", "secret", "token", "Token", '"', "'", " ", ":", "=", "abc", "x9+/_.", "é", "\n", "AKIA", "ABCDEFGH0123456789", "0123456789abcdef", "deadbeef"]), max_size=30))
def test_base_spans(parts):
    text = "".join(parts)
    assert spans_of(text, BASE) == plain(text)


def test_a_short_match_takes_its_text(spark):
    assert spans_of("secret: token: abcdefgh", BASE) == []
    assert spans_of("token=abc secret=abcdef", BASE) == [("assign", 10, 23)]


def test_whole_table(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    ledger = update_ledger(docs, str(tmp_path / "ledger"))
    got = {r.doc_id: r for r in digest(findings(docs, ledger, ["doc_id"]), ["doc_id"]).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        spans = plain(row.text)
        r = got[row.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for k, _, _ in spans) for n in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | set()


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "password=abcdefg"), (2, "password=abcdefg"), (3, None)], SCHEMA)
    assert update_ledger(first, path).count() == 4  # two blobs, two rule sets
    assert update_ledger(first, path).count() == 4
    more = first.union(spark.createDataFrame([(4, "new ghp_" + "a" * 36)], SCHEMA))
    assert update_ledger(more, path).count() == 6
    newer = RuleSet("base", 2, (*BASE.kinds, Kind("pin", r"pin=\d{4}")))
    ledger = update_ledger(more, path, (newer, EXTRA))
    assert ledger.count() == 9 and ledger.where("rule_set = 'base' AND rule_version = 2").count() == 3
    got = {r.doc_id: r for r in findings(more, ledger, ["doc_id"], (newer, EXTRA)).collect()}
    assert [s.kind for s in got[1].spans_base] == [s.kind for s in got[2].spans_base] == ["assign"]
    assert [s.kind for s in got[4].spans_extra] == ["hosted"] and got[3].spans_base == []


def test_defined_cases(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    ledger = update_ledger(empty, str(tmp_path / "empty"))
    assert digest(findings(empty, ledger, ["doc_id"]), ["doc_id"]).count() == 0
    long = "x" * 300_000 + " token: abcdef1"
    rows = [(1, None, "b"), (None, long, "b"), (2, "", "b"), (2, "", "b")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    got = digest(findings(odd, update_ledger(odd, str(tmp_path / "odd")), ["doc_id"]), ["doc_id"]).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(r.base_sha256 == nothing for r in got) == [False, True, True, True]
    assert [r.spans for r in got if r.doc_id is None] == ["assign:300001:300015"]


def test_a_pair_that_is_in_the_ledger_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "secret = abcdefgh"), (2, "secret = abcdefgh")], SCHEMA)
    once = digest(findings(docs, update_ledger(docs, path), ["doc_id"]), ["doc_id"]).orderBy("doc_id").collect()
    update_ledger(docs, path).write.mode("append").parquet(path)  # what two runs at a time leave
    twice = update_ledger(docs, path)
    assert twice.count() == 4
    assert digest(findings(docs, twice, ["doc_id"]), ["doc_id"]).orderBy("doc_id").collect() == once
    assert [r.n_assign for r in once] == [1, 1]


def test_a_second_run_scans_only_what_the_first_has_not(spark, tmp_path, tiny):
    path = str(tmp_path / "ledger")
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    first = update_ledger(docs.where("doc_id % 2 = 0"), path).count()
    files = set(spark.read.parquet(path).inputFiles())
    ledger = update_ledger(docs, path)
    new = [f for f in ledger.inputFiles() if f not in files]
    added = spark.read.parquet(*new)
    held = spark.read.parquet(*files)
    assert added.count() + first == ledger.count() and added.join(held, ["blob", "rule_set", "rule_version"]).count() == 0
    whole = update_ledger(docs, str(tmp_path / "other"))
    key = lambda d: sorted(map(tuple, digest(findings(docs, d, ["doc_id"]), ["doc_id"]).collect()))
    assert key(ledger) == key(whole)


def test_extra_kinds_have_no_upper_bounds():
    long = "p" * 500
    assert spans_of(f"see ftp://{'u' * 90}:{long}@host and redis://:{long}@h", EXTRA) == [("url", 7, 602), ("url", 616, 1121)]
    assert spans_of("http://a:b@c", EXTRA) == []
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\nMIIE+/=\n-----END RSA PRIVATE KEY-----"
    assert spans_of(f"x {key} y", EXTRA) == [("pem", 2, 2 + len(key))]
    assert spans_of("-----BEGIN PRIVATE KEY-----MIIE-----END PRIVATE KEY-----", EXTRA) == [("pem", 0, 56)]


def test_long_runs_are_scanned_in_one_go():
    import time

    start = time.time()
    for text in ("a." * 200_000, "a://" * 100_000, "x:" * 200_000, "-----BEGIN PRIVATE KEY-----" + "A" * 400_000, "-----BEGIN PRIVATE KEY-----\n" + "k: v\n" * 60_000):
        spans_of(text, EXTRA)
        spans_of(text, BASE)
    assert time.time() - start < 20
