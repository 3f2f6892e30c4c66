import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import quality_rules as rules
from scholia.llm import queries


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #\n\té €𝄞\x0b", max_size=80))
def test_base_counts(text):
    assert rules.counted(text)[0] == plain_base(text)


@pytest.mark.parametrize("text", [None, "", "a b c d e a b c d e", "x " * 50, "l1 a\nl1 a\n\n\n l1 a\nl1 a", "no repeat of five words here at all my friend"])
def test_base_counts_of(text):
    assert rules.counted(text)[0] == plain_base(text)


def plain_distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def plain_verdicts(rows):
    """kept of each (lang, text): mean histograms of fit documents, those of the nearer half again, then the distances."""
    data = []
    for lang, text in rows:
        base, classes, common = rules.counted(text)
        of = lang if lang in rules.COMMON else ""
        share = sum(common[k] for k in rules.own_words(of)) / max(1, sum(common))
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        data.append((of, base, classes, common, failed, not failed and base[1] >= rules.LEAST_CHARS and base[0] >= rules.LEAST_WORDS and share >= rules.LEAST_COMMON))

    def means(some):
        out = {}
        for of, _, classes, common, _, fit in some:
            if fit:
                for to in {of, ""}:
                    a, b = out.setdefault(to, ([0.0] * len(classes), [0.0] * len(common)))
                    out[to] = ([x + y / sum(classes) for x, y in zip(a, classes)], [x + y / sum(common) for x, y in zip(b, common)])
        return out

    def distances(row, known):
        of, base, classes, common = row[:4]
        if not known:
            return 0.0, 0.0
        a, b = known.get(of, known[""])
        at = rules.own_words(of)
        split = lambda c, n: [*[c[k] for k in at], n - sum(c[k] for k in at)]
        return plain_distance(classes, a), plain_distance(split(common, base[0]), split(b, sum(b)))

    first = [distances(row, means(data)) for row in data]
    middle = {}
    for of in {row[0] for row in data}:
        some = [d for row, d in zip(data, first) if row[0] == of and not row[4]]
        if some:
            middle[of] = tuple(sorted(x)[math.ceil(len(x) / 2) - 1] for x in zip(*some))
    known = means([row for row, d in zip(data, first) if row[0] in middle and all(x <= y + 1e-12 for x, y in zip(d, middle[row[0]]))])
    out = []
    for row in data:
        (c, w), base = distances(row, known), row[1]
        far = base[1] >= rules.LEAST_CHARS and c**2 > rules.MOST_CLASSES**2 + rules.CLASS_NOISE / base[1] or base[0] >= rules.LEAST_WORDS and w**2 > rules.MOST_WORDS**2 + rules.WORD_NOISE / base[0]
        out.append((*base, row[4], not row[4] and not far))
    return out


def test_kept_documents(spark, docs):
    good = [(k, " ".join(f"the lamp{j} of thing{j * k % 17} and was in a room{j}," for j in range(k % 30 + 2))) for k in range(80)]
    junk = [(200, " ".join(f"WORD{k}!!" for k in range(80))), (201, " ".join(f"x{k}$$$ y{k}###" for k in range(60))), (202, " ".join(f"noun{k}able" for k in range(200)))]
    df = docs([*good, *junk]).withColumn("lang", __import__("pyspark").sql.functions.expr("if(doc_id = 3, null, if(doc_id = 4, 'zz', 'en'))"))
    got = rules.kept_documents(df).collect()
    assert len(got) == df.count()
    rows = df.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_verdicts([(r.lang, r.text) for r in rows]))]
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r.kept for r in got}
    assert not by[200] and not by[201] and not by[202] and any(by[k] for k in range(80))
    assert rules.kept_documents(docs([], extra=False)).count() == 0


def test_a_corpus_of_junk_makes_no_reference_of_itself(spark):
    """Nine of ten documents are junk of one kind, and longer: the rest still passes, and the junk does not."""
    rnd = random.Random(2)
    names = [f"{a}{b}{c}{d}" for a in ("mo", "ta", "ri", "lu") for b in ("na", "sem", "kol", "de") for c in ("", "pe", "so", "gu") for d in ("", "r", "n", "st")]
    good = [(k, "en", " ".join(w for _ in range(20) for w in ("the", rnd.choice(names), "of", rnd.choice(names), "was", "in", rnd.choice(names)))) for k in range(30)]
    junk = [(100 + k, "en", " ".join(rnd.choice(names).upper() + f"{rnd.randrange(999)}$$$" for _ in range(900))) for k in range(270)]
    got = {r.doc_id: r.kept for r in rules.kept_documents(spark.createDataFrame([*good, *junk], "doc_id long, lang string, text string")).collect()}
    assert all(got[k] for k, *_ in good) and not any(got[k] for k, *_ in junk)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.table(spark, sf, "documents").collect()
    got = {r.doc_id: tuple(r)[1:8] for r in queries.QUERIES["op5_quality_rules"](spark, sf).collect()}
    assert got == {r.doc_id: x for r, x in zip(rows, plain_verdicts([(r.lang, r.text) for r in rows]))}
