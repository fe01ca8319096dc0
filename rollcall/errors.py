"""What can go wrong, by the part of the registry that says so."""


class RegistryError(Exception):
    """Any failure of the registry."""


class ConfigError(RegistryError):
    """A setting is missing or malformed."""


class NameGenerationError(RegistryError):
    """No name could be made."""

    def __init__(self):
        super().__init__("Could not generate a name.")


class PasswordError(RegistryError):
    """A password configuration that no password can meet."""


class StoreError(RegistryError):
    """The store refused or failed."""


class NotFound(StoreError):
    """No record has the key."""


class ConstraintViolation(StoreError):
    """A record breaks a not-null, key or unique rule."""


class StatementRefused(StoreError):
    """A database or catalog understood a statement and refused it."""


class PoolTimeout(StoreError):
    """No connection became free in time."""


class WriteConflict(StoreError):
    """Another writer took the next version first."""


class MigrationError(RegistryError):
    """A migration failed, or an applied one was changed."""


class CodecError(RegistryError):
    """A JSON body isn't what the schema asks for."""


class RequestError(RegistryError):
    """A request that can't be routed or read."""
