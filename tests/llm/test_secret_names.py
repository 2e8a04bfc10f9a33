import pytest

from verbascope.llm import secrets

VALUE = "aB3$dE5&fG7hI9jK"


@pytest.mark.parametrize("text", [
    f'password: str = "{VALUE}"', f'token: Optional[str] = "{VALUE}"', f'config["password"] = "{VALUE}"', f"config['api_key'] = '{VALUE}'", f'password = (\n    "{VALUE}")', f'password = ("{VALUE}")',
    f'password:\n  "{VALUE}"', f"<password>{VALUE}</password>", f'note: password = "{VALUE}"',
])
def test_found(text):
    assert VALUE in [text[x.value_start : x.value_end] for x in secrets.literal_spans(text)]


@pytest.mark.parametrize("text", [f'name: str = "{VALUE}"', f'config["name"] = "{VALUE}"', f'password:\n  "{VALUE}": 1', f"<name>{VALUE}</name>", f'password = f(\n "{VALUE}")'])
def test_left(text):
    assert VALUE not in [text[x.value_start : x.value_end] for x in secrets.literal_spans(text)]


def found(text):
    return [text[x.start : x.end] for x in secrets.literal_spans(text)]


@pytest.mark.parametrize("name", ["password", "x" * 120 + "_password", "password_" + "x" * 3000, "_" * 62 + "token", "_" * 63 + "token", "_" * 64 + "token"])
@pytest.mark.parametrize("gap", [0, 1, 10, 54, 55, 56, 140, 5000])
def test_names_and_gaps_of_any_length(name, gap):
    assert found(f'see {name}{" " * gap}= "{VALUE}"') == [VALUE]
    assert found(f'{name}"{" " * gap}: "{VALUE}"') == [VALUE]


def test_a_type_of_any_length():
    assert found(f'password: dict[str, {"list[int], " * 50} str] = "{VALUE}"') == [VALUE]


def test_doubling_constants():
    """A constant of 2 ** 10,000 characters costs no more than its 10,000 lines."""
    import time

    text = f'k0 = "{VALUE}"\n' + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(10_000)) + "password = k10000"
    began = time.perf_counter()
    assert found(text) == [VALUE]
    assert time.perf_counter() - began < 2
    growing = 'password0 = "a"\n' + "".join(f'password{i + 1} = password{i} + "a"\n' for i in range(5_000))
    began = time.perf_counter()
    assert found(growing) == []
    assert time.perf_counter() - began < 2
    weak = 'k0 = "xxxx"\n' + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(2000)) + "password = k2000"
    assert found(weak) == []


def test_joined_constants_are_scored_as_a_whole():
    assert sorted(found('a = "Xy7"\nb = "$kk29Zq"\npassword = a + b')) == ["$kk29Zq", "Xy7"]
    assert found('a = "Xy7$kk29Zq4"\nb = a\na = "true"\npassword = a\ntoken = b') == ["Xy7$kk29Zq4"]


def test_long_values_are_scored_like_their_text():
    for text in ("x" * 300, "x" * 299 + "y", "your " + "Ab1$" * 50, "your\n" + "Ab1$" * 50, "<" + "Ab1$" * 50 + ">", "Ab1$" * 50):
        assert secrets.HARMLESS.match(secrets.Value(text).alike()) is None or secrets.HARMLESS.match(text) is not None
        assert (secrets.HARMLESS.match(secrets.Value(text).alike()) is None) == (secrets.HARMLESS.match(text) is None)
