import numpy as np
import pytest

from photolith.llm import near_dup as N
from tests.llm.test_near_dup import brute_classes


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("few, more, times", [(256, 81, 2), (250, 95, 3), (200, 140, 9)])
def test_texts_on_both_sides_of_the_number_of_shingles_share_a_bucket(seed, few, more, times):
    keys = np.unique(np.random.default_rng(seed).integers(0, 2**63, few + more, dtype=np.uint64))
    inside = np.random.default_rng(seed + 100).permutation(few + more) < few
    weight = np.where(inside, 1.2 * (1 + np.log(times)), 1.2)
    a, b = (keys[inside], weight[inside]), (keys, weight)
    assert N.similarity(a, b) >= N.THRESHOLD
    assert len(a[0]) <= N.FULL and len(b[0]) > N.Sampling().overlap
    assert set(N.bands(*a).tolist()) & set(N.bands(*b).tolist())


def test_sampling_follows_the_threshold():
    plan = N.Sampling()
    assert (plan.rows, plan.bands, plan.samples, plan.overlap) == (5, 24, N.SAMPLES, 336)
    for threshold in (0.3, 0.5, 0.65, 0.7, 0.75, 0.9, 0.99, 1.0):
        plan = N.Sampling(threshold)
        assert (1 - threshold**plan.rows) ** plan.bands <= N.MISSED and plan.samples <= len(N._ODD) and plan.overlap >= N.FULL / threshold
    for threshold in (0.29, 0.0, 1.01):
        with pytest.raises(ValueError):
            N.Sampling(threshold)


@pytest.mark.parametrize("few, more", [(250, 342), (250, 354), (250, 334), (256, 340)])
def test_texts_of_unequal_length_are_one_class_at_a_lower_threshold(spark, few, more):
    words = [f"w{i}" for i in range(more + 4)]
    rows = [(1, " ".join(words[: few + 4])), (2, " ".join(words))]
    found = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.7).collect()
    assert [r.class_id for r in found] == [1, 1]


@pytest.mark.parametrize("threshold", [0.65, 0.75, 0.8, 0.9])
def test_classes_equal_all_pairs_at_other_thresholds(spark, threshold):
    rng = np.random.default_rng(int(threshold * 100))
    rows = []
    for k in range(60):
        size = int(rng.choice([8, 30, 120, 255, 290, 400]))
        words = [f"{k}-{i}" for i in range(size)]
        rows.append((10 * k, " ".join(words)))
        for i in range(3):
            other = list(words)
            for at in rng.choice(size, rng.integers(0, max(2, size // 25)), replace=False):
                other[at] = f"x{rng.integers(10**9)}"
            rows.append((10 * k + i + 1, " ".join(other[: int(size * rng.choice([1, 1, 0.8, 0.7]))])))
    found = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_classes(rows, threshold)
