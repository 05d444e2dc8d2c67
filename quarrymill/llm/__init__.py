"""Operators that prepare text for training data.  The core never imports
this subpackage; it may be deleted without touching the rest."""
