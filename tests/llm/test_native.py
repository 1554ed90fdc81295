"""Sharding, secrets, chat, licences and URL lists against direct versions, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from moodcast.llm import chat_format as C
from moodcast.llm import license_scan as L
from moodcast.llm import queries as Q
from moodcast.llm import secret_scan as S
from moodcast.llm import sharding as H
from moodcast.llm import url_lists as U
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, empty_docs, sentence


# ---- sharding ------------------------------------------------------------------

def jump(key, n):
    state = int(hashlib.md5(b"null" if key is None else f"={key}".encode()).hexdigest()[:15], 16)
    at, nxt = -1, 0
    while nxt < n:
        at = nxt
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        nxt = int((at + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return at


def test_jump_hash_equals_the_published_loop(spark):
    for n in (1, 2, 16, 1000):
        df = spark.range(300).select("id", H.jump_shard(F.col("id"), n).alias("s"))
        assert all(r["s"] == jump(r["id"], n) for r in df.collect())


def test_sharding_query(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = Q.QUERIES["op3_jump_sharding"](spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(text) and len(rows) == len(text)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == jump(r["doc_id"], 16) and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_edge_rows(spark):
    rows = H.shard_documents(edge_docs(spark), 4).collect()
    assert len(rows) == 16 and all(r["id"] == "clash" for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert H.shard_documents(empty_docs(spark), 4).count() == 0


# ---- secrets ---------------------------------------------------------------------

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{z}" for a, k, z in spans)


KEY = "".join(random.Random(11).choices(S.UPPER + S.LOWER + S.DIGITS + "+/", k=120))


def test_secrets_query_equals_direct_scan(spark):
    sf_dir = "/root/testdata/sf0.01"   # the smaller one holds no secrets
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = 0
    for r in Q.QUERIES["op7_randomness_secrets"](spark, sf_dir).collect():
        spans = base(text[r["doc_id"]])
        found += len(spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert r["n_added"] > 0 or r["spans"] == joined(spans)
    assert found


def test_secret_spans_on_awkward_texts(spark):
    texts = [None, "", 'é\U0001F600 Token = "abc" secret:token:abcdefgh API_KEY=\'x.y=z-1/2\'',
             "xAKIA" + "A1" * 9 + " AKIAAKIA0 " + "AKIA" + "Z" * 40, "0" * 23 + "g" + "f" * 24, "token=abcde token=abcdef",
             "token=secret=password=abcdefg", f"a {KEY} b", "well " + "thaninthewarren" * 6 + " end", "a/b/c/" * 30,
             "1234567890" * 8, "passwd : \"" + "0123456789abcdef" * 3 + "\""]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, at string")
    rows = {r["doc_id"]: r for r in S.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in rows[i]["base_spans"]] == base(t or ""), t
    assert [(s["start"], s["end"]) for s in rows[7]["added_spans"]] == [(2, 2 + len(KEY))]
    assert not any(rows[i]["added_spans"] for i in (8, 9, 10))
    masked = {r["doc_id"]: r for r in S.mask_secrets(df).collect()}
    assert masked[7]["text"] == "a [SECRET] b" and masked[7]["n_chars"] == 12
    assert masked[11]["text"] == '[SECRET]"' and masked[0]["text"] is None
    assert masked[8]["text"] == texts[8] and masked[8]["n_chars"] == 0
    assert S.mask_secrets(df).columns == df.columns


@pytest.mark.parametrize("length", [32, 40, 64])
def test_keys_of_ordinary_length_among_words(spark, length):
    rng = random.Random(length)
    plain = ["getElementsByClassNameFromRoot", "SPARK_SQL_SHUFFLE_PARTITIONS", "Donaudampfschifffahrtsgesellschaft",
             "src/main/java/org/apache/spark/sql/catalyst", "abcdefghijklmnopqrstuvwxyz", "12345678901234567890",
             "INTERNATIONALIZATIONSERVICE", "the-quick-brown-fox-jumps-over-the-lazy-dog"]
    keys = ["".join(rng.choices(S.UPPER + S.LOWER + S.DIGITS + "+/", k=length)) for _ in range(20)]
    df = spark.createDataFrame([(i, f"{sentence(20, i)} {t} and more") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {r["doc_id"]: [s["part"] for s in r["added_spans"]] for r in S.find_secrets(df).collect()}
    assert sum(found[i] == [k] for i, k in enumerate(keys)) >= 18
    assert not any(found[i] for i in range(len(keys), len(found)))


def cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_normal_tails(spark):
    z = [x / 4 for x in range(-48, 25)]
    rows = spark.createDataFrame([(x,) for x in z], "z double").selectExpr("z", f"{S.normal_cdf('z')} as p").collect()
    for r in rows:
        assert abs(r["p"] / cdf(r["z"]) - 1) < 3e-7


def direct_battery(part):
    """(encoding, p) of a run, by plain loops."""
    name, letters, effect = next(e for e in S.ENCODINGS if set(part) <= set(e[1]))
    n, k = len(part), len(letters)
    x = [letters.index(c) + 1 for c in part]
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(1, k + 1))
    up = [v * 2 > k for v in x]
    n1 = sum(up)
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    mu = 2 * n1 * (n - n1) / n + 1
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    cov = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    battery = cdf((chi - (k - 1 + n * effect)) / math.sqrt(2 * (k - 1 + 2 * n * effect)))
    structured = mu <= 2 or var == 0
    if mu > 2:
        sd = math.sqrt((mu - 1) * (mu - 2) / (n - 1))
        battery = max(battery, cdf((abs(runs - mu) - S.DEPENDENCE * (mu - 1)) / sd))
        structured = structured or abs(runs - mu) > S.FAR * sd
    else:
        battery = 1.0
    if var:
        r = abs(cov / var) * math.sqrt(n)
        battery = max(battery, cdf(r - S.DEPENDENCE * math.sqrt(n)))
        structured = structured or r > S.FAR
    else:
        battery = 1.0
    structured = structured or abs(chi - (k - 1)) > S.FAR * math.sqrt(2 * (k - 1) * (n - 1) / n)
    rate = [0.9 * v / sum(S.LETTER_RATES) + 0.1 / 26 for v in S.LETTER_RATES]
    symbols = sum(math.log2(rate[ord(c) - 97] if c in S.LOWER else 0.1 if c in S.DIGITS else 0.25) for c in part.lower())

    def chain(order):
        last, total = 0, 0.0
        for c in part:
            kind = "l" if c in S.LOWER else "u" if c in S.UPPER else "d" if c in S.DIGITS else "m"
            at = order.index(kind)
            total += math.log2(S.CLASS_RATES[last][at] / 100)
            last = at + 1
        return total

    text = 1.0 if name == "decimal" else len(S.ENCODINGS) * 2 ** (symbols + max(chain("ludm"), chain("uldm")) + n * math.log2(k))
    return name, battery if structured else min(1.0, 2 * battery, 2 * text)


def planted_runs():
    rng = random.Random(4)
    runs = ["".join(rng.choices(e[1], k=n)) for e in S.ENCODINGS for n in (20, 24, 33, 64, 200)]
    runs += ["getElementsByClassNameFromRoot", "SPARK_SQL_SHUFFLE_PARTITIONS", "a" * 30, "ab" * 20, "1234567890" * 4,
             "src/main/java/org/apache/spark", "the-quick-brown-fox-jumps-over", "Z" * 19 + "a", "zzzzzzzzzzzzzzzzzzzzB"]
    return [r for r in runs if not re.fullmatch("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", r)]


def test_battery_and_discovery_step_equal_direct_versions(spark):
    runs = planted_runs()
    df = spark.createDataFrame([(i, f"word {r}, word") for i, r in enumerate(runs)], "doc_id long, text string")
    scored = (df.withColumn("s", F.expr(S._scan("text"))).select("doc_id", F.explode(F.expr(S._scored("s.runs"))).alias("r"))
              .select("doc_id", "r.*"))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(runs)
    p = {}
    for i, run in enumerate(runs):
        name, want = direct_battery(run)
        assert got[i]["part"] == run and got[i]["encoding"] == name and got[i]["n"] == len(run)
        assert got[i]["p"] == pytest.approx(want, rel=1e-6, abs=1e-290), run
        p[i] = want
    # the weighted step on p-values rounded up to bins, by sorting all of them
    mean = sum(map(len, runs)) / len(runs)
    up = {i: 2.0 ** (-min(S.BINS, max(0, math.floor(-math.log2(max(v * mean / len(runs[i]), 1e-300)) * S.BINS_PER_OCTAVE)))
                     / S.BINS_PER_OCTAVE) for i, v in p.items()}
    order = sorted(up.values())
    last = max((k for k, v in enumerate(order, 1) if len(runs) * v <= S.FDR * k), default=0)
    threshold, avg = S.discovery_threshold(scored)
    assert avg == pytest.approx(mean) and sum(v <= threshold for v in up.values()) == last
    # rounding is on the safe side of the step without bins
    exact = sorted((v * mean / len(runs[i]), i) for i, v in p.items())
    most = max((k for k, (v, _) in enumerate(exact, 1) if len(runs) * v <= S.FDR * k), default=0)
    found = {r["doc_id"] for r in S.find_secrets(df).collect() if r["added_spans"]}
    assert found == {i for i in p if p[i] * mean / len(runs[i]) <= threshold}
    assert found <= {i for _, i in exact[:most]} and len(found) > 20


def test_many_secrets_in_one_text(spark):
    """20,000 digests, as many assignments and keys: positions and masks of a plain scan, in work that follows the text."""
    rng = random.Random(9)
    lines = []
    for k in range(20_000):
        lines.append(hashlib.sha256(str(k).encode()).hexdigest() + f"  é😀{k}.txt")
        if k % 2:
            lines.append(f"token={k:08d}x password = '{rng.getrandbits(48):012x}' ok")
        if k % 100 == 0:
            lines.append("".join(rng.choices(S.UPPER + S.LOWER + S.DIGITS + "+/", k=64)) + " end")
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text, len(text)), (2, "none", 4)], "doc_id long, text string, n_chars long")
    began = time.perf_counter()
    row = next(r for r in S.find_secrets(df).collect() if r["doc_id"] == 1)
    masked = {r["doc_id"]: r for r in S.mask_secrets(df).collect()}
    assert time.perf_counter() - began < 120
    assert [(s["start"], s["kind"], s["end"]) for s in row["base_spans"]] == base(text)
    assert len(row["added_spans"]) > 190 and all(text[s["start"]:s["end"]] == s["part"] for s in row["added_spans"])
    out, at = [], 0
    for s in sorted(row["base_spans"] + row["added_spans"]):
        if s["start"] >= at:
            out += [text[at:s["start"]], S.MASK]
        at = max(at, s["end"])
    want = "".join(out) + text[at:]
    assert masked[1]["text"] == want and masked[1]["n_chars"] == len(want) and masked[2]["text"] == "none"


def test_masks_of_overlapping_spans(spark):
    texts = ["0123456789abcdef01234567api_key=secretvalue1 x", "token=" + "ab" * 20 + ".x", "AKIA" + "Z" * 20 + "token=abcdefg",
             "x" * 3000 + " " + "0a" * 700 + " é" * 900 + " passwd:abcdefgh", "0a" * 512 + "token=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "base_spans long, text string")
    for r in S.mask_secrets(df).collect():
        text, out, at = texts[r["base_spans"]], [], 0
        for a, _, z in base(text):
            if a >= at:
                out += [text[at:a], S.MASK]
            at = max(at, z)
        assert r["text"] == "".join(out) + text[at:]


def test_secrets_edge_rows(spark):
    assert S.find_secrets(edge_docs(spark)).count() == 16
    assert sorted(map(str, S.mask_secrets(edge_docs(spark)).collect())) == sorted(map(str, edge_docs(spark).collect()))
    assert S.mask_secrets(empty_docs(spark)).count() == 0


# ---- chat ------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip_on_awkward_rows(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\</s>", "[\\INST]", None, "", " x ", "<<SYS>> a <</SYS>>\n", "\\", "<", "$1 \\1",
             "<<ROLE>> a: b <</ROLE>>", "é\U0001F600"]
    rows = [(1, k, ["user", "assistant"][k % 2], t, "clash") for k, t in enumerate(texts)]
    rows += [(2, 0, "tool: x", "</s>", ""), (2, 1, None, "n", ""), (None, 5, "user", "q", ""), (None, None, "system", "s", ""),
             (3, 0, "user", "a", ""), (3, 0, "user", "a", ""), (4, 0, "assistant", "</s>", "")]
    df = spark.createDataFrame(rows, CHAT)
    out = C.format_conversations(df).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn(
        "loss", C.loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:len(texts)]]
    assert got[1]["loss"] == "".join(t or "" for t in texts[1::2]) and got[1]["valid"]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("tool: x", "</s>"), ("", "n")]
    assert (got[2]["valid"], got[2]["error_at"]) == (False, 0)
    assert [t["role"] for t in got[None]["turns"]] == ["system", "user"] and got[None]["valid"]
    assert (got[3]["valid"], got[3]["error_at"]) == (False, 1)
    assert (got[4]["error_at"], got[4]["loss"]) == (0, "</s>")
    for r in got.values():
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
    assert C.format_conversations(df.limit(0)).count() == 0


def test_template_rejects_ambiguous_marks():
    with pytest.raises(ValueError):
        C.Template(turns=(C.Turn("a", "<x>", "</x>"), C.Turn("b", "<x>y", "</y>")))


# ---- licences ----------------------------------------------------------------------

def test_licence_forms(spark):
    known = L.known_digests(spark)
    mit = "Copyright (c) 2020 Some One\n\n" + L.MIT.replace(",", " ,").upper()
    rows = [(1, mit), (2, "Intro line.\n\n" + L.MIT + "\n\nmore"), (3, "text\nLicenced under the Apache Licence, version 2.0"),
            (4, L.MIT + " and more"), (5, None), (None, "Released under the MIT License."), (7, "…!"), (8, "")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["unit"], r["license"]) for r in L.scan(df, known).collect()}
    assert got == {(1, "text", "MIT"), (2, "paragraph", "MIT"), (3, "line", "Apache-2.0"), (None, "text", "MIT")} | (
        {(1, "paragraph", "MIT")} & got)
    assert L.scan(edge_docs(spark), known).count() == 0 and L.scan(empty_docs(spark), known).count() == 0


def test_whole_licences_and_licences_in_larger_files(spark):
    known = L.known_digests(spark)
    own = "Copyright (c) 2020 Some One\n\n"
    texts = {p.stem: p.read_text() for p in L.PUBLISHED.glob("*.txt")}
    mit, bsd3 = L.MIT.replace("\n", "\n\n"), L.BSD3.replace("\n", "\n\n")
    rows = [(name, text) for name, text in texts.items()] + [
        ("bsd3", "BSD 3-Clause License\n\n" + own + bsd3), ("mit inside", "A readme.\n\nMIT License\n\n" + own + mit + "\n\nThe end."),
        ("bsd3 inside", "Intro\n\n" + own + bsd3 + "\n\nmore\n\n" + mit), ("cut", "Intro\n\n" + mit.rsplit("\n\n", 1)[0] + "\n\nend"),
        ("joined", "Intro\n\n" + mit + " and more"), ("apache inside", "Intro words\n\n" + texts["Apache-2.0"] + "\n\nmore")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = collections.defaultdict(set)
    for r in L.scan(df, known).collect():
        got[r["doc_id"]].add((r["unit"], r["license"]))
    assert all(("text", name) in got[name] for name in texts)
    assert got["bsd3"] >= {("text", "BSD-3-Clause")} and got["mit inside"] >= {("paragraphs", "MIT")}
    assert got["bsd3 inside"] >= {("paragraphs", "BSD-3-Clause"), ("paragraphs", "MIT")}
    assert not got["cut"] and not got["joined"] and ("paragraphs", "Apache-2.0") in got["apache inside"]


def direct_runs(paragraphs, known):
    """(position, licence) of the runs of two or more paragraphs, not all, whose joined forms are a known text."""
    forms = [p for p in paragraphs if p]
    out = set()
    for i in range(len(forms)):
        for z in range(i + 2, len(forms) + 1):
            if z - i < len(forms):
                out |= {(i, lic) for lic in known.get(" ".join(forms[i:z]), ())}
    return out


def test_runs_equal_all_runs(spark):
    rng = random.Random(2)
    known_texts = [("A", "one two\n\nthree four five six seven"), ("B", "one two\n\nthree four\n\none two three"), ("C", "three four\none two\n\nthree four five"),
                   ("D", "alpha beta gamma delta epsilon zeta\n\neta"), ("E", "one two")]
    known = collections.defaultdict(set)
    for lic, t in known_texts:
        known[" ".join(t.split())].add(lic)
    parts = ["one two", "three four", "three four five six seven", "alpha beta gamma delta epsilon zeta", "eta", "...", "five", "one two three"]
    texts = ["\n\n".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(200)] + ["\n\n".join(rng.choices(parts, k=1500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in L.scan(df, L.known_digests(spark, tuple(known_texts))).where("unit = 'paragraphs'").collect():
        got[r["doc_id"]].add((r["position"], r["license"]))
    for i, t in enumerate(texts[:-1]):
        assert got[i] == direct_runs([p.replace(".", "") for p in t.split("\n\n")], known), t
    assert len(got[200]) > 50


def test_long_notices(spark):
    """1,000 licences in one text of over 1 MB: each is found, in work that follows the text."""
    mit = L.MIT.replace("\n", "\n\n")
    text = "\n\n".join(f"package{k} by its writers\n\nCopyright (c) 20{k % 100:02d} Writer {k}\n\n{mit}" for k in range(1000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    rows = L.scan(df, L.known_digests(spark)).collect()
    assert time.perf_counter() - began < 60
    assert len(text) > 1_000_000
    assert sorted(r["position"] for r in rows if r["unit"] == "paragraphs") == [4 * k + 1 for k in range(1000)]


def test_copyright_lines(spark):
    lines = ["Copyright Joyent, Inc. and other Node contributors.", "Copyright The Kubernetes Authors", "Copyright Foo Inc. 2019",
             "Portions copyright (c) 2001 Some One", " * Copyright 2020 A", "(c) 2020 B", "All rights reserved."]
    terms = ["copyright notice and this permission", "COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS", "copyright and related rights 1999",
             "copyright owner or its contributors"]
    df = spark.createDataFrame([(x,) for x in lines + terms], "t string").select("t", L.canonical(F.col("t")).alias("c"))
    form = {r["t"]: r["c"] for r in df.collect()}
    assert all(form[x] == "" for x in lines) and all(form[x] for x in terms)
    rows = [(k, f"{x}\n{L.MIT}") for k, x in enumerate(lines)]
    found = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), L.known_digests(spark)).where("unit = 'text'").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(lines)))


def test_licences_in_comments(spark):
    known = L.known_digests(spark)
    header = L.APACHE_HEADER.split("\n")
    mit = L.MIT.split("\n")
    rows = [(1, "/*\n * Copyright 2020 A\n *\n * " + "\n *\n * ".join(header) + "\n */\npackage x;\nint a;"),
            (2, "#!/bin/sh\n# tool that does things\n#\n# " + "\n#\n# ".join(header) + "\nset -e\nls"),
            (3, "// " + "\n// ".join(mit) + "\nfn main() {}"), (4, "/* " + "\n\n".join(mit) + " */ int x;"),
            (5, "/* some words */ int x; // others"), (6, "-- " + "\n-- ".join(header) + "\n--\n-- more\nselect 1")]
    got = collections.defaultdict(set)
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect():
        got[r["doc_id"]].add((r["unit"], r["license"]))
    assert {k: ("comment", "Apache-2.0") in got[k] for k in (1, 2, 6)} == {1: True, 2: True, 6: True}
    assert ("comment", "MIT") in got[3] and ("comment", "MIT") in got[4] and not got[5]


# ---- URL lists ----------------------------------------------------------------------

def test_temporal_lists(spark):
    changes = spark.createDataFrame([
        ("spam", "bad.org", "add", "block", 100), ("spam", "bad.org", "add", "block", 100),
        ("spam", "BAD.org", "remove", "block", 200), ("spam", "bad.org", "add", "block", 10**8),
        ("ok", "www.bad.org/good", "add", "allow", 0), ("spam", "x.org", "add", "block", 50),
        ("spam", "x.org", "remove", "block", 50), (None, "y.org", "add", "block", 0), ("spam", None, "add", "block", 0),
        ("spam", "z.org", "add", "block", None)], "list string, key string, action string, verdict string, time long")
    rows = [(1, "http://bad.org/", 99), (2, "http://bad.org/", 100), (3, "http://u@www.BAD.org:80/x?y", 199),
            (4, "http://bad.org", 200), (5, "http://bad.org", 10**8), (6, "https://www.bad.org/good/a", 150),
            (7, None, 150), (8, "http://bad.org", None), (9, "nohost", 150), (10, "http://x.org", 60),
            (2, "http://bad.org/", 100), (11, "http://notbad.org", 150), (None, "http://y.org", 10)]
    df = spark.createDataFrame([(i, u, t, "clash") for i, u, t in rows], "page_id long, url string, fetched_at long, lists string")
    out = U.judge(df, changes).collect()
    assert len(out) == len(rows)
    got = {(r["page_id"], r["verdict"], tuple(r["lists"])) for r in out}
    assert got == {(1, None, ()), (2, "block", ("spam",)), (3, "block", ("spam",)), (4, None, ()), (5, "block", ("spam",)),
                   (6, "allow", ("ok", "spam")), (7, None, ()), (8, None, ()), (9, None, ()), (10, None, ()),
                   (11, None, ()), (None, None, ())}
    assert U.judge(df.limit(0), changes).count() == 0
    assert {r["verdict"] for r in U.judge(df, changes.limit(0)).collect()} == {None}
    # other spans give the same verdicts
    again = {(r["page_id"], r["verdict"], tuple(r["lists"])) for r in U.judge(df, changes, span=10**7).collect()}
    assert again == got
