"""What several test modules share. Not in conftest: a module of that name exists in tests/llm too."""


def close(a, b, tol=1e-6):
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
