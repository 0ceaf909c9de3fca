"""Schemas and fixed vocabularies of the key-value, log, transaction and lock relations."""

from __future__ import annotations

PUT, DELETE = "PUT", "DELETE"
KV_LOG = "k string, ts long, op string, v double"
BATCH = "pos long, op string, k string, v double"
LAYERS = "layer_rank int, k string, ts long, op string, v double"
MANIFEST = "seq long, kind string, level int, id long"
TXNS = "txn_id long, start_ts long, commit_ts long, isolation string"
TXN_OPS = "txn_id long, k long, op string"
LOCKS = "txn_id long, k long, mode string"
RANGES = "txn_id long, lo long, lo_inc boolean, hi long, hi_inc boolean"

# Default parameters.
MEMTABLE_BYTES = 4 << 20
BLOCK_BYTES = 4096
L0_TRIGGER, LEVEL_FACTOR, LEVEL_BASE_BYTES, LAST_LEVEL = 4, 10, 10 << 20, 6
BLOOM_BITS_PER_KEY, BLOOM_PROBES = 10, 7
SEGMENT_BYTES, KEEP_SEGMENTS = 64 << 20, 2
WARN_LOCKS, ESCALATE_LOCKS, FORCE_LOCKS = 1000, 5000, 10000
LOGICAL_BITS = 18
LOCK_TIMEOUT = 10.0

# Lock modes, the pairs of them that go together, and the legal upgrades.
MODES = ("S", "X", "IS", "IX", "SIX")
COMPATIBLE = (("S", "S"), ("S", "IS"), ("IS", "S"), ("IS", "IS"), ("IS", "IX"), ("IS", "SIX"), ("IX", "IS"), ("IX", "IX"), ("SIX", "IS"))
UPGRADES = (("S", "X"), ("S", "SIX"), ("IS", "S"), ("IS", "X"), ("IS", "IX"), ("IS", "SIX"), ("IX", "X"), ("IX", "SIX"))

ISOLATION = ("Snapshot", "Serializable", "SerializableReadOnly", "SerializableDeferrable")


class StoreError(Exception):
    """A request that the store refuses."""


class ReadOnlyError(StoreError):
    """A write by a read-only transaction."""


class ClosedTransactionError(StoreError):
    """An operation of a transaction that has committed or aborted."""


class ConflictError(StoreError):
    """A commit that validation refused; `verdict` names the conflict."""

    def __init__(self, verdict: str):
        super().__init__(verdict)
        self.verdict = verdict


class LockError(StoreError):
    """A lock that is not granted."""

    message = "lock error"

    def __init__(self):
        super().__init__(self.message)


# What each says.
def _lock_error(name: str, message: str) -> type[LockError]:
    return type(name, (LockError,), {"message": message, "__doc__": message})


LockTimeoutError = _lock_error("LockTimeoutError", "lock acquisition timed out")
DeadlockError = _lock_error("DeadlockError", "deadlock detected")
TransactionAbortedError = _lock_error("TransactionAbortedError", "transaction was aborted")
EscalationError = _lock_error("EscalationError", "lock escalation failed")
RangeConflictError = _lock_error("RangeConflictError", "range lock conflict")
RangeLocksDisabledError = _lock_error("RangeLocksDisabledError", "range locks are disabled")
NotHeldError = _lock_error("NotHeldError", "lock not held by transaction")
InvalidUpgradeError = _lock_error("InvalidUpgradeError", "invalid lock upgrade path")
