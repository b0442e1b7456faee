"""Syllables of one voice against a plain walk over the notes."""

import pytest

from stavelake.operators import timeline as L
from tests.test_queries import random_elements


def walked(notes, voice):
    """The notes that one syllable after another takes: a note of another voice is passed over only if the voice follows in its measure."""
    at, taken = 0, []
    while at < len(notes):
        measure = notes[at]["measure_no"]
        if notes[at]["voice"] == voice or not any(n["voice"] == voice for n in notes[at:] if n["measure_no"] == measure):
            taken.append((measure, notes[at]["seq"]))
        at += 1
    return taken


@pytest.mark.parametrize("voice", [1, 2, 3])
def test_a_voice_that_rests_lends_its_syllables(spark, voice):
    notes = L.attachable(random_elements(spark, 5)[0])
    plain = [r.asDict() for r in notes.orderBy("measure_no", "seq").collect()]
    want = walked(plain, voice)
    got = [tuple(r) for r in L.sung_by(notes, voice).orderBy("measure_no", "seq").select("measure_no", "seq").collect()]
    own = [(n["measure_no"], n["seq"]) for n in plain if n["voice"] == voice]
    assert got == want and len(own) < len(want)


def test_the_query_places_syllables_beside_the_voice(spark, small):
    from stavelake.plans import catalog
    from stavelake.plans.bindings import Bindings

    rows = catalog.QUERIES["lyric_zip_voice"](spark, small).join(Bindings(spark, small).se, ["score_id", "part_no", "measure_no", "seq"])
    assert {r.voice for r in rows.select("voice").distinct().collect()} == {1, 2}
