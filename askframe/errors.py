"""What is refused, by name."""


class Refusal(Exception):
    """A question that can't be answered honestly; reason is a short name."""

    def __init__(self, reason: str, words: str):
        super().__init__(f"{reason}: {words}")
        self.reason, self.words = reason, words
