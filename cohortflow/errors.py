"""Typed failures. The UI the package replaces turned these into message texts;
here every failure raises instead of returning an empty frame."""


class CohortError(Exception):
    pass


class InvalidEnvelope(CohortError):
    def __init__(self, missing=()):
        super().__init__("Invalid file format. Required columns: id, name, object, relations"
                         + (f" (missing: {', '.join(missing)})" if missing else ""))
        self.missing = tuple(missing)


class MissingEntity(CohortError):
    pass


class NoValidRows(CohortError):
    pass


class NoMatchingIds(CohortError):
    pass


class MissingColumn(CohortError):
    pass
