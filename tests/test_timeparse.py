import pytest

from vigil.functions.timeparse import since_ms

NOW = 1_735_700_000_000
HOUR = 3_600_000


@pytest.mark.parametrize(
    "text, a, b, c",
    [
        ("1h", NOW - HOUR, NOW - HOUR, NOW - HOUR),
        ("1 H", NOW - HOUR, None, NOW - HOUR),
        ("30s", None, NOW - 30_000, None),
        ("2hours", None, None, NOW - 2 * HOUR),
        ("15 min", None, None, NOW - 900_000),
        ("3d", NOW - 72 * HOUR, NOW - 72 * HOUR, NOW - 72 * HOUR),
        ("2025-01-01T00:00:00Z", None, None, 1_735_689_600_000),
        ("abc", None, None, None),
    ],
)
def test_dialects(text, a, b, c):
    for dialect, wanted in zip("abc", (a, b, c)):
        assert since_ms(text, NOW, dialect, strict=False) == wanted
        if wanted is None:
            with pytest.raises(ValueError):
                since_ms(text, NOW, dialect)


def test_no_text_means_no_filter():
    assert since_ms(None, NOW) is None
    assert since_ms("", NOW) is None
