"""Row functions: keys, tokens, insertion counts, hashing and bits, each as Python kernel and, where it can be, as Column."""
