import math
import zlib
from collections import defaultdict

import pytest
import zstandard

from leafclock.llm import common, quality_classifier, toxicity

HELD = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark, frame, prose):
    rows, labels = [], []
    for i in range(400):
        text = prose(i, 60 + i % 50)
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text = text[:40] + " grunk! " + text[40:] + " you vile grunk"
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None), (901, ""), (902, "ok " * 50_000), (None, "no id"), (5, rows[5][1])]
    labels += [(5, labels[5][1], labels[5][2]), (None, 1, 1), (77_777, 0, 0), (6, None, None)]
    return frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:400]}


@pytest.mark.parametrize("module,label,column", [(quality_classifier, "quality", 0), (toxicity, "toxic", 1)])
def test_held_out_accuracy_and_odd_rows(corpus, module, label, column):
    docs, labels, truth = corpus
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    limit = 0.3 if module is quality_classifier else 0.5
    assert all(r.predicted == (r.score >= limit) for r in got)
    assert all(r.held_out == (r.doc_id is None or HELD(r.doc_id)) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id][column] for r in held) / len(held) > 0.95
    again = module.classify(docs.repartition(5), labels).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_scores_depend_on_the_text_alone(corpus, module, spark):
    docs, labels, _ = corpus
    held = labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0")
    flipped = labels.join(held.select("doc_id"), "doc_id", "left_anti").unionByName(
        held.selectExpr("doc_id", "1 - quality as quality", "1 - toxic as toxic"))
    one, two = ({str(r) for r in module.classify(docs, x).collect()} for x in (labels, flipped))
    assert one == two
    same = docs.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source")
    assert {str(r) for r in module.classify(same, labels).collect()} == one


@pytest.mark.parametrize("module,keep", [(quality_classifier, "keep_good"), (toxicity, "keep_clean")])
def test_filter_keeps_columns_and_rows(corpus, module, keep):
    docs, labels, _ = corpus
    out = getattr(module, keep)(docs, labels)
    wanted = 1 if module is quality_classifier else 0
    assert out.columns == docs.columns
    n = module.classify(docs, labels).where(f"predicted = {wanted}").count()
    assert out.count() == n


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_nothing_to_learn_from(frame, spark, module):
    docs = frame([(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], none.schema)
    assert [r.score for r in module.classify(docs, none).collect()] == [0.5, 0.5]
    assert module.classify(docs, one).count() == 2
    assert module.classify(docs.limit(0), one).count() == 0


def test_weights_equal_a_plain_ftrl(corpus):
    """One coordinate at a time, in a dict, over the rows in the order of the stream."""
    docs, labels, _ = corpus
    bits, alpha, beta, l1 = 20, 2.0, 1.0, 3.0
    rows = sorted(common.labelled_sample(docs, labels, "toxic", 250).collect(), key=lambda r: (r.draw, r.doc_id))
    assert len(rows) in (250, 251), "the id that occurs twice has two rows"
    hashes, z, n, bias = common.WordHashes(), defaultdict(float), defaultdict(float), [0.0, 0.0]

    def weight(z, n):
        return 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((beta + math.sqrt(n)) / alpha)

    for r in rows:
        at = {int(i) for i in toxicity.features((r.text or "").encode(), hashes, bits)}
        w = {i: weight(z[i], n[i]) for i in at}
        b = -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)
        g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + b)))) - r.y
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
        bias = [bias[0] + g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / alpha * b, bias[1] + g * g]
    want = {i: weight(z[i], n[i]) for i in z if weight(z[i], n[i])}
    model = toxicity.fit(docs, labels, max_rows=250)
    assert sorted(model.index.tolist()) == sorted(want) and len(want) > 10
    assert all(math.isclose(want[i], w, rel_tol=1e-6) for i, w in zip(model.index.tolist(), model.weight))
    assert math.isclose(model.bias, -bias[0] / ((beta + math.sqrt(bias[1])) / alpha), rel_tol=1e-6)


def test_scores_equal_plain_compression(corpus):
    docs, labels, _ = corpus
    model = quality_classifier.fit(docs, labels, piece=100)
    assert model.good and model.bad and len(model.weights) == 3

    def size(text, data):
        packer = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(data),
                                          write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(text[i:i + 100])) for i in range(0, len(text), 100))

    got = quality_classifier.score(docs.where("doc_id < 40 or doc_id >= 900"), model).collect()
    assert len(got) > 40
    for r in got:
        text, (a, b, c) = (r.text or "").encode(), model.weights
        d = ratio = 0.0
        if text:
            bad, good = size(text, model.bad), size(text, model.good)
            least = min(bad, good)
            d, ratio = (bad - good) / (least + 64), math.log((least + 64) / (len(text) + 128))
        assert math.isclose(r.score, 1 / (1 + math.exp(-(a * d + b * ratio + c))), rel_tol=1e-9)


@pytest.mark.parametrize("draws", ["xxhash64(id)", "cast(9000000000000000000 as bigint)"])
@pytest.mark.parametrize("wanted", [1, 7, 100, 5_000])
def test_the_smallest_draws_are_taken(spark, draws, wanted):
    """Also where all draws are one large number, so that the bound leaves nothing."""
    pieces = spark.range(1000).selectExpr(f"{draws} as draw", "encode(cast(id as string), 'utf-8') as piece")
    want = [bytes(r.piece) for r in sorted(pieces.collect(), key=lambda r: (r.draw, bytes(r.piece)))[:wanted]]
    assert quality_classifier._smallest(pieces, wanted, 1000) == want
