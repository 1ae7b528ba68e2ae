from barloom.llm import lines


def test_bands_reach_the_threshold():
    """Sixteen bands of five rows: at most two in a thousand pairs at the threshold are missed."""
    assert (1 - lines.SIMILARITY**lines.ROWS) ** lines.BANDS <= 0.002
