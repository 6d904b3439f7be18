"""Errors by the part of the engine that they come from; each prints with its part's name."""


class TextloomError(Exception):
    part = "error"

    def __str__(self) -> str:
        return f"{self.part}: {super().__str__()}"


class ConfigError(TextloomError):
    part = "config"


class ModelError(TextloomError):
    part = "model"


class TokenizerError(TextloomError):
    part = "tokenizer"


class InferenceError(TextloomError):
    part = "inference"


class InputOutputError(TextloomError):
    part = "io"
