import hashlib
import math

import corpus_pipeline
import public_tokenizers
import tiktoken

from kgrules.llm import mixing, toxicity
from kgrules.llm.bpe import ranks_of

SMALL = "/root/testdata/sf0.001"


def groups(sets, percent):
    """The smallest member that links reach, by comparing all pairs that share anything."""
    at, holders = {i: i for i in sets}, {}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    seen = set()
    for i, s in sets.items():
        for x in s:
            for j in holders.setdefault(x, []):
                if (j, i) not in seen:
                    seen.add((j, i))
                    if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                        a, b = sorted((root(i), root(j)))
                        at[b] = a
            holders[x].append(i)
    return {i: root(i) for i in sets}


def plain_lines(rows):
    """Documents without the lines that another, earlier one is near to; those without any line left go."""
    at = {(i, k): line for i, t in rows.items() for k, line in enumerate((t or "").split("\n")) if line.strip()}
    plain = {k: v.strip().lower() for k, v in at.items()}
    of = {}
    for k, p in sorted(plain.items()):
        of.setdefault(p, []).append(k)
    sets = {v[0]: {p[j : j + 8] for j in range(max(1, len(p) - 7))} for p, v in of.items()}
    lead = groups(sets, 80)
    kept = {v[0] for v in of.values() if lead[v[0]] == v[0]}
    out = {}
    for i, t in rows.items():
        lines = (t or "").split("\n")
        left = [k for k in range(len(lines)) if not lines[k].strip() or (i, k) in kept]
        if t is None or not any(s.strip() for s in lines) or any(lines[k].strip() for k in left):
            out[i] = t if t is None else "\n".join(lines[k] for k in left)
    return out


def plain_copies(rows):
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    lead = groups(sets, 80)
    return {i: t for i, t in rows.items() if lead[i] == i}


def plain_mix(rows, columns):
    """A draw of 90 % of the tokens: fitted by plain loops, then scaled."""
    form = lambda t: "empty" if not t.strip(" ") else "list" if " | " in t else "markup" if "</" in t else "code" if ";\n" in t or "{\n" in t else "prose"
    keys = {i: (columns[i][0] or mixing.NONE, columns[i][1] or mixing.NONE, form(rows[i] or "")) for i in rows}
    size = {i: len((rows[i] or "").encode().split()) for i in rows}
    total, want, factor = sum(size.values()), [], []
    for d, power in enumerate((0.5, 0.5, 1.0)):
        sums = {}
        for i, k in keys.items():
            sums[k[d]] = sums.get(k[d], 0) + size[i]
        raised = {k: v**power for k, v in sums.items() if v}
        want.append({k: v / sum(raised.values()) for k, v in raised.items()})
        factor.append(dict.fromkeys(sums, 1.0))
    for _ in range(300):
        for d in range(3):
            now = dict.fromkeys(want[d], 0.0)
            for i, k in keys.items():
                if size[i]:
                    now[k[d]] += size[i] * math.prod(factor[e][k[e]] for e in range(3))
            for k in want[d]:
                factor[d][k] *= want[d][k] * total / now[k]
    full = {i: math.prod(factor[e][keys[i][e]] for e in range(3)) if size[i] else 1.0 for i in rows}
    low, high = 0.0, 1e6
    for _ in range(200):
        scale = (low + high) / 2
        low, high = (scale, high) if sum(size[i] * min(1, scale * full[i]) for i in rows) < 0.9 * total else (low, scale)
    draw = lambda i: int(hashlib.sha256(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return {i: t for i, t in rows.items() if draw(i) < min(1, low * full[i])}


def test_stages_and_run_against_brute_force(spark):
    """Each stage's rows equal those of plain Python on its own input, and run()'s rows those of the last stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    stages = dict(corpus_pipeline.STAGES)
    rejected = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    expected = {
        "toxicity": lambda x: {i: t for i, t in x.items() if i not in rejected},
        "lines": plain_lines,
        "near_copies": plain_copies,
        "mixing": lambda x: plain_mix(x, columns),
    }
    for name, plain in expected.items():
        out = stages[name](spark, docs, SMALL)
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs, rows = spark.read.parquet(path), plain(rows)
        assert {r.doc_id: r.text for r in docs.collect()} == rows, name
        assert all(r.n_chars == len(r.text or "") for r in docs.collect()) or name == "toxicity"
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(f.read()), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in rows.items():
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
