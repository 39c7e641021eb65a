"""Errors with stable codes."""


class SeriesError(ValueError):
    """``code`` is the contract; the text may change."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code
