def test_imports():
    import tessera

    assert tessera.__doc__
