"""Added spans: several of one kind beside each other."""

import pytest

from claimspark.llm import pii


def added(text, kind):
    return [text[s:e] for s, e, _ in pii.added_spans(text, [(0, len(text), kind)], pii.base_spans(text))]


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("phone", "(555) 123-4567 (555) 987-6543", ["(555) 123-4567", "(555) 987-6543"]),
        ("phone", "555-123-4567 555-987-6543", ["555-123-4567", "555-987-6543"]),
        ("phone", "555.123.4567 555.987.6543 555.111.2222", ["555.123.4567", "555.987.6543", "555.111.2222"]),
        ("phone", "123456 555-123-4567", ["555-123-4567"]),
        ("phone", "0044 207-946 0958", ["0044 207-946 0958"]),
        ("phone", "+1 (743) 555-3824 (555) 123-4567", ["(743) 555-3824", "(555) 123-4567"]),
        ("phone", "(555)123-4567", ["(555)123-4567"]),
        ("phone", "555 123 4567", []),
        ("email", "ann at x dot com bob at y dot org", ["ann at x dot com", "bob at y dot org"]),
        ("email", "ann@x.org bob at y dot org", ["bob at y dot org"]),
        ("card", "4111.1111.1111.1112 4111.1111.1111.1111", ["4111.1111.1111.1111"]),
    ],
)
def test_added_spans_finds_all_in_a_run(kind, text, want):
    assert added(text, kind) == want


def test_contacts_on_one_line_are_all_found():
    text = "call (555) 123-4567 (555) 987-6543"
    (_, every), = pii.spans_of([text], pii.field())
    assert [text[s:e] for s, e, kind in every if kind == "phone"] == ["(555) 123-4567", "(555) 987-6543"]


#: Lines labelled by hand, of another origin than the generator's templates: what the field should add to the base patterns ({} marks it).
BY_HAND = [
    ("You can reach Peter under {peter dot lang at posteo dot org} after six.", "email"), ("Her new address is {rosa(at)kiosk(dot)net}, the old one is dead", "email"), ("bookings: {desk[at]hall-nine[dot]com}!", "email"),
    ("Ring {(415) 555-0142} and ask for Lou", "phone"), ("my mobile number was {212-555-0187} until May", "phone"), ("Tel. {0049 171 5550123-4}", "phone"), ("the office picks up at {646.555.0199} most days", "phone"),
    ("She paid with {5500.0000.0000.0004} on Monday", "card"), ("card no. {4111/1111/1111/1111} exp 09/27", "card"),
]
CLEAN = [
    "We met at the dot on the map at noon.", "Version 10.4.2.11234 was cut on 2024-11-05.", "Order 4711-0815 of 12.03.2024 came to 1.299,00.", "ISBN 978-3-16-148410-0 is out of print", "Room 212, floor 3, building 7.", "He ran 400 metres in 55.12 at the age of 17.",
    "The score was 21-19, 15-21, 15-13.", "look at example dot matrix printers", "1234 5678 9012 3456 isn't a card", "The 2019-2020 season had 380 games.",
]


def test_field_adds_what_was_labelled_by_hand():
    """Precision and recall of added spans on lines that no template made: the field must add most of them, and next to nothing else."""
    texts = [line.replace("{", "").replace("}", "") for line, _ in BY_HAND] + CLEAN
    found = pii.spans_of(texts, pii.field())
    added = [[x for x in every if x not in base] for base, every in found]
    hits = 0
    for (line, kind), (base, every) in zip(BY_HAND, found, strict=False):
        start, end = line.index("{"), line.index("}") - 1
        hits += any(k == kind and s < end and e > start for s, e, k in every if (s, e, k) not in base)
    wrong = sum(map(len, added[len(BY_HAND) :]))
    print(f"recall {hits}/{len(BY_HAND)}, added to clean lines {wrong}")
    assert hits >= 6 and wrong <= 1
