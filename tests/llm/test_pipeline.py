"""Every stage of the pipeline against a plain version, over a table with planted copies, passages and junk."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
from curves.llm import mixing, packing, quality_rules
from tests.llm.data import SCHEMA, prose
from tests.llm.test_mixing_and_packing import allot
from tests.llm.test_near_copies import edited, likeness
from tests.llm.test_quality_and_lines import WORD, base, dedup

BOILERPLATE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), quality_rules.BOILERPLATE))


def bad_line(line):
    ws = WORD.findall(line)
    if not ws:
        return False
    marks, separators = len(re.findall(r"[#*$%&|<>!=~^_+{}\[\]\\]", line)), sum(w in ("|", ">", "»", "•", "·") for w in ws)
    return (
        marks * 100 > sum(map(len, ws)) * 10 or (separators >= 3 and separators * 100 > len(ws) * 20) or (len(ws) <= 25 and bool(BOILERPLATE.search(line.lower())))
    )


def quality(docs):
    out = []
    for i, text, source in docs:
        n, chars, _, _, repeats = base(text)
        lines = (text or "").split("\n")
        lost = sum(len("".join(WORD.findall(x))) for x in lines if bad_line(x))
        if n >= 20 and repeats * 100 <= n * 30 and lost * 100 <= chars * 50:
            out.append((i, "\n".join(x for x in lines if not bad_line(x)), source))
    return out


def lines(docs):
    texts = dedup([t for _, t, _ in docs], 50)
    return [(i, new, source) for (i, old, source), new in zip(docs, texts, strict=True) if new == old or new.split()]


def near_duplicates(docs):
    root = {i: i for i, _, _ in docs}
    for k, (i, a, _) in enumerate(docs):
        for j, b, _ in docs[:k]:
            if likeness(a.lower(), b.lower()) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    return [d for d in docs if root[d[0]] == d[0]]


def mixed(docs):
    leaf = lambda source: (f"dom{int(source[3:]) % 4}", "en", source)
    leaves = {}
    for _, text, source in docs:
        leaves[leaf(source)] = leaves.get(leaf(source), 0) + len(text.split())
    out = []
    for path, given in allot(leaves, mixing.WEIGHTS, corpus_pipeline.MIX_SHARE, corpus_pipeline.MIX_EPOCHS).items():
        full, rest = divmod(given, leaves[path])
        order = lambda i, e=full + 1: int(hashlib.md5(f"{mixing.SEED}:{e}:{i}".encode()).hexdigest()[:15], 16)
        seen = 0
        for doc in sorted((d for d in docs if leaf(d[2]) == path), key=lambda d: order(d[0])):
            seen += len(doc[1].split())
            out += [doc] * (full + (seen <= rest))
    return sorted(out)


def packed(docs):
    """Lengths of the pieces of each bin, with its capacity; all are one shard."""
    lengths = sorted((len(t.split()) for _, t, _ in docs), reverse=True)
    bins, sizes = packing.pack_items(lengths)
    return sorted((size, sorted(lengths[i] for i in b)) for b, size in zip(bins, sizes, strict=True))


def table():
    rng, texts = random.Random(11), []
    for i in range(60):
        texts.append("\n".join(prose(100 * i + k, rng.randint(8, 40), 5000) for k in range(rng.randint(2, 8))))
    passage = "\n".join(prose(9000 + k, 30, 5000) for k in range(2))
    for i in range(0, 60, 7):
        texts[i] = f"{texts[i]}\n{passage}\n{prose(9100 + i, 12)}"
    texts += [texts[3], texts[3], texts[10].upper(), *(edited(texts[i], i, 2) for i in range(12, 20))]
    texts += [f"{texts[20]}\nAll rights reserved.\nhome | news | sport | about", "x " * 60, "too short", "A!! B!! C!! " * 12, None, "", " \n\t", passage]
    return [(i, t, f"src{i % 5}") for i, t in enumerate(texts)]


def test_stages_equal_their_plain_versions(spark):
    rows = table()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", 2, 3) for i, t, s in rows], SCHEMA)
    plain = {"quality_rules": quality, "line_dedup": lines, "simhash_near_dedup": near_duplicates, "mixing": mixed}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, ""))
        if name == "packing":
            assert sorted((r.capacity, sorted(r.lengths)) for r in out.collect()) == packed(rows)
            assert sorted(d for r in out.collect() for d in r.doc_ids) == sorted(i for i, _, _ in rows)
            break
        before, rows = len(rows), plain[name](rows)
        assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == sorted(rows), name
        assert 0 < len(rows) < before or name == "line_dedup", name
        assert all(r.n_chars == len(r.text) for r in out.collect())
        docs = out
