import pytest

from wayline.plans.events import EventError, class_matches, duration_ms, parse_event

CONVOY = {
    "version": 1,
    "event": "two_in_a_row",
    "roles": {"A": {"class": "vehicle"}, "B": {"class": "car"}},
    "pattern": {"seq": [{"enters": {"object": "A"}}, {"within": {"max": "1.5m", "pattern": {"all": [{"exits": {"object": "A"}}, {"enters": {"object": "B"}}]}}}]},
}


def test_a_definition_is_read():
    event = parse_event(CONVOY)
    assert event.pattern.role_names() == ("A", "B")
    assert event.pattern.children[1].most_ms == 90_000
    assert event.pattern.children[1].children[0].most_ms == 300_000
    assert event.common_roles() == ()


@pytest.mark.parametrize("text,ms", [("3s", 3000), ("1.5h", 5_400_000), (".5s", 500), ("250ms", 250)])
def test_durations(text, ms):
    assert duration_ms(text) == ms


@pytest.mark.parametrize("bad", [3, "3", "1.5ms", "s", None, "3 s"])
def test_bad_durations(bad):
    with pytest.raises(EventError):
        duration_ms(bad)


@pytest.mark.parametrize(
    "change,says",
    [
        ({"colour": 1}, "unknown field"),
        ({"version": 2}, "version"),
        ({"event": "Convoy"}, "lower-case"),
        ({"roles": {"a": {"class": "vehicle"}}}, "upper-case"),
        ({"roles": {"A": {"class": "dragon"}}}, "dragon"),
        ({"pattern": {"enters": {"object": "Z"}}}, "not a declared role"),
        ({"pattern": {"seq": [{"enters": {"object": "A"}}]}}, "two patterns"),
        ({"pattern": {"teleports": {"object": "A"}}}, "unknown predicate"),
        ({"pattern": {"near": {"object_a": "A"}}}, "missing"),
        ({"pattern": {"near": {"object_a": "A", "object_b": "A"}}}, "two arguments"),
        ({"pattern": {"present": {"object": "A", "minimum_confidence": 2}}}, "outside"),
        ({"pattern": {"present": {"object": "A", "minimum_confidence": True}}}, "not of type"),
        ({"pattern": {"audio_event": {"class": "thunder"}}}, "thunder"),
        ({"pattern": {"boards": {"person": "A", "vehicle": "B"}}}, "does not take"),
        ({"pattern": {"within": {"min": "3s", "max": "2s", "pattern": {"enters": {"object": "A"}}}}}, "min is more"),
        ({"pattern": {"within": {"max": 3, "pattern": {"enters": {"object": "A"}}}}}, "no duration"),
        ({"pattern": {"k_of_n": {"k": 3, "patterns": [{"enters": {"object": "A"}}, {"exits": {"object": "A"}}]}}}, "k must be"),
        ({"pattern": {"for": {"duration": "1s", "pattern": {"any": [{"enters": {"object": "A"}}, {"exits": {"object": "A"}}]}}}}, "only a predicate"),
    ],
)
def test_what_is_wrong_is_said(change, says):
    with pytest.raises(EventError, match=says):
        parse_event(CONVOY | change)


def test_all_errors_are_reported_together():
    with pytest.raises(EventError) as e:
        parse_event(CONVOY | {"version": 3, "event": "X"})
    assert "version" in str(e.value) and "lower-case" in str(e.value)


def test_classes():
    assert class_matches("vehicle", "truck") and class_matches("traffic_light", "Traffic light")
    assert not class_matches("car", "truck") and not class_matches("person", "dog")
