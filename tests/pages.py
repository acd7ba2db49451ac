"""Pages for the test of the paged source."""


def fetch(page: int, size: int) -> list[dict]:
    return [{"n": page * size + k} for k in range(size)]
