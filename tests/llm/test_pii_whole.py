from docloom.llm import pii


def found(text, kind):
    return [text[a:b] for a, b, k in pii.candidates(text, pii.base_spans(text)) if k == kind]


def test_spelt_beside_ordinary_address():
    spelt = "ann [at] example [dot] com"
    for text in (f"bob@x.org or {spelt}", f"{spelt}, @handle", f"{spelt} and bob@x.org " * 3):
        assert set(found(text, "email")) == {spelt}, text
    assert found("ann (At) example.com", "email") == ["ann (At) example.com"]
    assert found("bob@x.org (at) y.com", "email") == []


def test_secret_to_its_end():
    for secret in ("a1B2c3D4" * 40, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJ-SMeKKF2QT4fw_pM"):
        text = f'token = "{secret}". Next'
        a, b, kind = next(s for s in pii.candidates(text, pii.base_spans(text)) if s[2] == "secret")
        assert text[a:b] == secret and pii.votes(text, a, b, kind)[5] == "0"
    assert found("password: abcdefgh1. Then", "secret") == ["abcdefgh1"]
