import pytest

from tidewell.llm import licenses as X

GRANTS = {
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction": "MIT",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "SPDX-License-Identifier: MIT": "MIT",
}


@pytest.mark.parametrize("length", [0, 300, 1000, 50_000])
@pytest.mark.parametrize("grant", GRANTS)
def test_whatever_the_length_of_the_sentence(grant, length):
    """A licence that opens a stretch without a sentence end is found however long the stretch is."""
    text = grant + " and so on" * length
    assert [(n.lower(), a, b) for n, a, b in X.find_licenses(text)] == [(GRANTS[grant].lower(), 0, len(text))]
