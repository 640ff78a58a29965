"""DataFrame operators that no single SQL expression covers."""
