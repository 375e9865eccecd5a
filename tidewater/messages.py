"""Error texts that logic tests match."""

from __future__ import annotations

# The phrases that logic scripts expect; the rest of each text is free.
DUPLICATE = "Constraint Error: Duplicate key in {table} ({columns}) violates {kind} constraint: PRIMARY KEY or UNIQUE constraint violation"
NOT_NULL = "Constraint Error: NOT NULL constraint failed: {table}.{column}"
CHECK = "Constraint Error: CHECK constraint failed on {table}"
NO_PARENT = "Constraint Error: Violates foreign key constraint of {table}: a key does not exist in the referenced table {parent}"
STILL_REFERENCED = "Constraint Error: Violates foreign key constraint of {child}: a key of {table} is still referenced by a foreign key in a different table"
IS_PARENT = 'Catalog Error: Could not drop the table because this table is main key table of the table "{child}"'
HAS_DEPENDENTS = 'Dependency Error: Cannot alter entry "{table}" because there are entries that depend on it.'
PARENT_IS_VIEW = "Binder Error: cannot reference a VIEW with a FOREIGN KEY"
IN_FOREIGN_KEY = "Catalog Error: column {column} is involved in the foreign key constraint of {table}"
TYPE_OF_KEY = "Binder Error: Cannot change the type of a column that has a UNIQUE or PRIMARY KEY constraint specified"
DEPENDED_ON = "Catalog Error: column {column} can't go: there is a {kind} constraint that depends on it"
NO_TABLE = "Catalog Error: Table with name {table} does not exist"
TABLE_EXISTS = "Catalog Error: Table with name {table} already exists"
NO_COLUMN = 'Binder Error: {table} does not have a column named "{column}"'
NO_SOURCE = 'Binder Error: table "{table}" not found in the FROM clause'
ABORTED = "TransactionContext Error: the transaction is aborted by a failed statement and can only be rolled back"
CONFLICT = "TransactionContext Error: conflict: another transaction has changed {table}, which counts as a constraint violation"
