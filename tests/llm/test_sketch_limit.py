from evalweave.llm import neardup


def test_sketches_reject_nothing_within_seven_deviations():
    for t in (0.8, 0.85):
        assert neardup.odd_limit("n", t) == neardup.odd_limit("n", t, 7.0)
