"""Errors with the codes that callers act on."""


class IndexUnavailable(RuntimeError):
    """The vector index can't be read."""

    code = 3003

    def __init__(self, where: str):
        super().__init__(f"{self.code}: vector index unavailable at {where}")
